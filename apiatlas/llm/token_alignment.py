"""Cross-tokenizer alignment by inverted pair bitmaps.

Two tokenizers cut the same bytes. Byte offsets where tokens of both end cut the text into
groups, and all pairs of an A token and a B token of one group are linked. Documents are
numbered within chunks; for each id pair of a chunk there is a list of compressed bitmaps over
the chunk's numbers: the first marks the documents that hold the pair (the pieces of a chunk
are OR-merged into it), the others are the bit planes of how often a document repeats it. A
bitmap is a sorted array of 16-bit numbers, or a plain bit set where that is shorter. A pair's
corpus-wide count is the sum of its chunks' population counts; the postings then carry the
count, and whether it is the highest of the A id, back to the documents of each chunk, where
the planes weigh it.

What is shuffled are the compressed postings: once to meet their counts by pair, once to
return by chunk. A chunk is bounded in documents and bytes. The vocabularies are read on the
driver and broadcast; their size is fixed.

Cases: texts that are null or empty, or whose tokens' bytes are not space + text, have no tokens:
zeros and an empty digest; special tokens' strings are plain text; a text of any length is one
document of one chunk; rows that repeat a document are documents of their own, in counts
too; an empty table gives no rows; columns other than id and text are not carried.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiatlas.llm.bpe import byte_symbols
from apiatlas.llm.common import release, ship
from apiatlas.session import write_table

ship(__name__)

#: Pre-tokens of the public byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of a chunk at most, the bytes of text that close one, and bytes aligned at once.
CHUNK, CHUNK_BYTES, SLICE_BYTES = 4096, 8 << 20, 1 << 19
#: 16-bit units of a plain bit set over a chunk; arrays are shorter.
UNITS = CHUNK // 16
ORD_BITS, ID_BITS = 12, 16


def load_vocabularies(byte_level: str, pieces: str) -> tuple[dict[bytes, int], bytes]:
    """Token bytes -> id of the byte-level vocabulary (special tokens left out), and the piece model."""
    with open(byte_level, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
        raise ValueError("expected a byte-level BPE vocabulary without normaliser and prefix space")
    byte_of = {symbol: b for b, symbol in enumerate(byte_symbols())}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    with open(pieces, "rb") as f:
        return ranks, f.read()


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode("utf-8")
            for i, p in ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))]


class Tokenizer:
    """One side: token ids of a text, and every id's bytes, byte length and decimal strings."""

    def __init__(self, encode, tokens: list[bytes], last: str):
        self.encode = encode
        if len(tokens) >= 1 << ID_BITS:
            raise ValueError("ids of more than 16 bits")
        self.bytes = np.array([*tokens, None], object)[:-1]
        self.length = np.array([len(t) for t in tokens], np.int64)
        # the decimal id as it stands inside a group's list, and as its last
        self.decimal = np.array([s for i in range(len(tokens)) for s in (f"{i},", f"{i}{last}")], object)

    def fits(self, ids: np.ndarray, text: bytes) -> bool:
        return b"".join(self.bytes[ids].tolist()) == text


def tokenizers(spec: tuple[dict[bytes, int], bytes]) -> tuple[Tokenizer, Tokenizer]:
    ranks, model = spec
    own = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    return (Tokenizer(lambda t: own.encode_ordinary(" " + t), tokens, "|"),
            Tokenizer(lambda t: pieces.encode(t), piece_bytes(pieces), ";"))


def _runs(group: np.ndarray, ids: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) in order with their number of tokens, and each group's number of them."""
    keys, count = np.unique(group.astype(np.int64) << ID_BITS | ids, return_counts=True)
    at = keys >> ID_BITS
    return at, keys & ((1 << ID_BITS) - 1), count, np.bincount(at, minlength=groups)


def links_of(ga: np.ndarray, a: np.ndarray, gb: np.ndarray, b: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, A id, B id, links) of every pair of distinct ids that share a group."""
    at, ida, ca, _ = _runs(ga, a, groups)
    _, idb, cb, nb = _runs(gb, b, groups)
    start = np.cumsum(nb) - nb
    times = nb[at]
    i = np.repeat(np.arange(len(at)), times)
    j = start[at][i] + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
    return at[i], ida[i], idb[j], ca[i] * cb[j]


class Slice:
    """Alignment of some documents' tokens, end to end: document ends are ends of both sides'
    tokens, so no group crosses them."""

    def __init__(self, sides: tuple[Tokenizer, Tokenizer], texts: list):
        one, two = sides
        empty = np.empty(0, np.int64)
        ids_a, ids_b, sizes = [], [], []
        for text in texts:
            a = b = empty
            if text:
                raw = b" " + text.encode("utf-8")
                a, b = np.array(one.encode(text), np.int64), np.array(two.encode(text), np.int64)
                if not (one.fits(a, raw) and two.fits(b, raw)):
                    a = b = empty
            ids_a.append(a)
            ids_b.append(b)
            sizes.append(len(raw) if len(a) else 0)
        self.n_a = np.array([len(a) for a in ids_a], np.int64)
        self.n_b = np.array([len(b) for b in ids_b], np.int64)
        n = len(texts)
        a, b = np.concatenate([empty, *ids_a]), np.concatenate([empty, *ids_b])
        ends_a, ends_b = np.cumsum(one.length[a]), np.cumsum(two.length[b])
        place = np.minimum(np.searchsorted(ends_b, ends_a), max(len(ends_b) - 1, 0))
        common = ends_a[ends_b[place] == ends_a] if len(ends_b) else empty
        ga, gb = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        owner = np.searchsorted(np.cumsum(np.array(sizes, np.int64)), common)  # the document of every group
        self.n_groups = np.bincount(owner, minlength=n)
        group, one_id, two_id, times = links_of(ga, a, gb, b, len(common))
        doc = owner[group]
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, doc, times)
        # an id pair and a document of this slice in one number: what a chunk holds on to is small
        self.links, self.times = (one_id << ID_BITS | two_id) << ORD_BITS | doc, times.astype(np.int32)
        self.digest = self._digests(sides, a, b, ga, gb, len(common))

    def _digests(self, sides, a, b, ga, gb, groups: int) -> list[str]:
        """Digest of each document's groups, written as `a1,a2|b1;a3|b2,b3`."""
        one, two = sides
        in_a, in_b = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
        words = np.empty(len(a) + len(b), object)
        last_a, last_b = np.ones(len(a), bool), np.ones(len(b), bool)
        last_a[:-1], last_b[:-1] = ga[1:] != ga[:-1], gb[1:] != gb[:-1]
        words[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[ga]] = one.decimal[2 * a + last_a]
        words[np.arange(len(b)) + np.cumsum(in_a)[gb]] = two.decimal[2 * b + last_b]
        out, at = [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append(hashlib.sha256("".join(words[at:at + n].tolist())[:-1].encode()).hexdigest() if n else "")
            at += n
        return out


def pack(pair: np.ndarray, number: np.ndarray, further: np.ndarray, pairs: int) -> pa.ListArray:
    """Every pair's list of bitmaps. Entries are sorted by (pair, document number); ``further`` is
    how many links a document has beyond the first."""
    most = np.zeros(pairs, np.int64)
    np.maximum.at(most, pair, further)
    planes = 1 + np.ceil(np.log2(most + 1)).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(planes)])
    slots, numbers = [base[pair]], [number]
    for k in range(int(planes.max(initial=1)) - 1):
        some = (further >> k) & 1 == 1
        slots.append(base[pair[some]] + 1 + k)
        numbers.append(number[some])
    slot, number = np.concatenate(slots), np.concatenate(numbers)
    order = np.argsort(slot << ORD_BITS | number)
    slot, number = slot[order], number[order]
    held = np.bincount(slot, minlength=base[-1])
    units = np.where(held >= UNITS, UNITS, held)
    offset = np.concatenate([[0], np.cumsum(units)])
    data = np.zeros(offset[-1], np.uint16)
    dense = (held >= UNITS)[slot]
    rank = np.arange(len(slot)) - (np.cumsum(held) - held)[slot]
    data[offset[slot[~dense]] + rank[~dense]] = number[~dense]
    np.bitwise_or.at(data, offset[slot[dense]] + (number[dense] >> 4), (1 << (number[dense] & 15)).astype(np.uint16))
    maps = pa.Array.from_buffers(pa.binary(), int(base[-1]), [None, pa.py_buffer((2 * offset).astype(np.int32)), pa.py_buffer(data)])
    return pa.ListArray.from_arrays(pa.array(base.astype(np.int32)), maps)


def unpack(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, document number, links that this entry stands for) of all entries of the bitmaps."""
    base = lists.offsets.to_numpy().astype(np.int64)
    maps = lists.values.slice(base[0], base[-1] - base[0])
    base = base - base[0]
    offset = np.frombuffer(maps.buffers()[1], np.int32)[maps.offset:maps.offset + len(maps) + 1].astype(np.int64)
    raw = maps.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offset[0]:offset[-1]].copy().view(np.uint16) if raw is not None else np.empty(0, np.uint16)
    units = np.diff(offset) // 2
    slot = np.repeat(np.arange(len(maps)), units)
    unit = np.arange(len(slot)) - np.repeat(np.cumsum(units) - units, units)
    dense = (units == UNITS)[slot]
    at, bit = np.nonzero((data[dense][:, None] >> np.arange(16, dtype=np.uint16)) & 1)
    slots = np.concatenate([slot[~dense], slot[dense][at]])
    numbers = np.concatenate([data[~dense].astype(np.int64), unit[dense][at] * 16 + bit])
    row = np.repeat(np.arange(len(lists)), np.diff(base))
    place = np.arange(len(maps)) - base[row]
    weight = np.where(place == 0, 1, 1 << np.maximum(place - 1, 0))
    return row[slots], numbers, weight[slots]


def document_count(bitmaps: Column) -> Column:
    """Population count of a pair's first bitmap."""
    size = F.octet_length(bitmaps[0])
    return F.when(size == 2 * UNITS, F.bitmap_count(bitmaps[0])).otherwise((size / 2).cast("long"))


def inverted_pairs(docs: DataFrame, spec, doc_id: str, text: str) -> DataFrame:
    """Rows of documents (chunk, number, id, counts, digest) and, without a number, of pairs (chunk, a, b, bitmaps)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    fields = {"chunk": pa.int64(), "number": pa.int32(), "doc_id": None, "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(),
              "n_links": pa.int64(), "groups_sha256": pa.string(), "a": pa.int32(), "b": pa.int32(), "bitmaps": pa.list_(pa.binary())}

    def rows(n: int, id_type: pa.DataType, **columns) -> pa.RecordBatch:
        types = {**fields, "doc_id": id_type}
        return pa.record_batch([columns[c].cast(t) if c in columns else pa.nulls(n, t) for c, t in types.items()], names=list(types))

    def chunk(name: int, ids: list, slices: list[tuple[int, Slice]], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        n = sum(len(s.n_a) for _, s in slices)
        whole = lambda of: pa.array(np.concatenate([of(s) for _, s in slices]))
        yield rows(n, id_type, chunk=pa.array(np.full(n, name)), number=pa.array(np.arange(n)), doc_id=pa.concat_arrays(ids),
                   n_a=whole(lambda s: s.n_a), n_b=whole(lambda s: s.n_b), n_groups=whole(lambda s: s.n_groups), n_links=whole(lambda s: s.n_links),
                   groups_sha256=pa.array([d for _, s in slices for d in s.digest]))
        keys = np.concatenate([s.links + first for first, s in slices])
        times = np.concatenate([s.times for _, s in slices])
        slices.clear()
        if not len(keys):
            return
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        del order
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, times = keys[starts], np.add.reduceat(times, starts)
        pair, number = keys >> ORD_BITS, keys & (CHUNK - 1)
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        distinct = pair[new]
        step = 1 << 16  # pairs of a batch
        index = np.cumsum(new) - 1
        for at in range(0, len(distinct), step):
            some = distinct[at:at + step]
            lo, hi = np.searchsorted(index, [at, at + len(some)])
            maps = pack(index[lo:hi] - at, number[lo:hi], times[lo:hi] - 1, len(some))
            yield rows(len(some), id_type, chunk=pa.array(np.full(len(some), name)),
                       a=pa.array(some >> ID_BITS), b=pa.array(some & ((1 << ID_BITS) - 1)), bitmaps=maps)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = tokenizers(spec.value)
        task, made = TaskContext.get().partitionId() << 32, 0
        ids, slices, held, size, id_type = [], [], 0, 0, None
        for batch in batches:
            id_type = batch.column(0).type
            at = 0
            sizes = batch.column(1).cast(pa.large_binary())
            bounds = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset:sizes.offset + batch.num_rows + 1]
            while at < batch.num_rows:
                to = min(int(np.searchsorted(bounds, bounds[at] + SLICE_BYTES, side="right")), batch.num_rows, at + CHUNK - held)
                to = max(to, at + 1)
                slices.append((held, Slice(sides, batch.column(1).slice(at, to - at).to_pylist())))
                ids.append(batch.column(0).slice(at, to - at))
                held, size, at = held + to - at, size + int(bounds[to] - bounds[at]), to
                if held == CHUNK or size >= CHUNK_BYTES:
                    yield from chunk(task | made, ids, slices, id_type)
                    ids, slices, held, size, made = [], [], 0, 0, made + 1
        if held:
            yield from chunk(task | made, ids, slices, id_type)
        sides = ids = slices = batch = sizes = bounds = None
        release()

    schema = (f"chunk long, number int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "a int, b int, bitmaps array<binary>")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(align, schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best): how many documents hold each linked id pair, and whether that is the highest count of its A id."""
    counts = pairs.groupBy("a", "b").agg(F.sum(document_count(F.col("bitmaps"))).alias("count"))
    counts = write_table(counts)
    top = counts.groupBy("a").agg(F.max("count").alias("top"))  # a row for each id of the vocabulary at most
    return counts.join(F.broadcast(top), "a").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def return_scores(pairs: DataFrame, documents: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """The documents with n_best and count_sum, summed up from their chunk's postings."""
    fields = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def scores(table: pa.Table) -> pa.Table:
        docs = table.filter(pa.compute.is_valid(table.column("number")))
        best, total = np.zeros(CHUNK, np.int64), np.zeros(CHUNK, np.int64)
        for batch in table.filter(pa.compute.is_null(table.column("number"))).to_batches(max_chunksize=1 << 15):
            row, number, weight = unpack(batch.column("bitmaps"))
            count = batch.column("count").to_numpy()[row]
            top = batch.column("best").to_numpy(zero_copy_only=False)[row]
            np.add.at(total, number, weight * count)
            np.add.at(best, number[top], weight[top])
        at = docs.column("number").to_numpy()
        return docs.append_column("n_best", pa.array(best[at])).append_column("count_sum", pa.array(total[at])).select(fields)

    postings = pairs.join(counts, ["a", "b"]).select("chunk", "bitmaps", "count", "best")
    own = documents.select("chunk", "number", *[f for f in fields if f not in ("n_best", "count_sum")])
    together = own.unionByName(postings, allowMissingColumns=True)
    return together.groupBy("chunk").applyInArrow(
        scores, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of ``docs``.
    ``byte_level`` and ``pieces`` are vocabulary files that the driver reads."""
    spec = docs.sparkSession.sparkContext.broadcast(load_vocabularies(byte_level, pieces))
    table = write_table(inverted_pairs(docs, spec, doc_id, text))
    spec.destroy()
    pairs, documents = table.filter("number IS NULL"), table.filter("number IS NOT NULL")
    return return_scores(pairs, documents, pair_counts(pairs), docs.schema[doc_id].dataType.simpleString())
