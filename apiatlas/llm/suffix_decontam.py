"""Benchmark decontamination by suffix arrays over the training documents.

The words of a run of documents, as 64-bit hashes, make one shard; a shard's suffix array
sorts all its word positions by the words that follow (ranks of one word, then of three,
nine, ... words, until every suffix differs or the ranks are deeper than a window). Every
suffix of a test item that holds a window is binary-searched in every shard; the run of
training suffixes that begin with its window gives the locations. A location counts only
after its bytes have been compared, and locations that follow each other in the document and
in the item are one longer verbatim match. Shards are made in the tasks that read the documents, so nothing is shuffled; one
row a document leaves a task.

The test items are the only broadcast: at most ``BLOCK_BYTES`` of text at a time. A larger
benchmark is dealt into blocks, and the documents, with what they have gathered so far, are
read once for each block.

Cases: null and empty texts, and texts without words, have no words and are never hit; items
without words have no window; an item of fewer words than a window is one window; repeated
items count once by their id; items without an id hit words but are no items; rows that
repeat a document are judged each by itself; a document longer than a shard is searched
in overlapping shards, so no match is cut; without documents the result is empty, without
items no document is hit. Columns of the documents that clash with the results are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apiatlas.llm.common import fresh, mix64, ship
from apiatlas.session import write_table

ship(__name__)

#: Words of a window; words of a shard, about; bytes hashed at once.
WINDOW, SHARD, PIECE = 10, 1 << 19, 1 << 21
#: Documents whose results are built at once.
SLICE = 1024
#: Bytes of test items' text that are searched in one pass.
BLOCK_BYTES = 8 << 20

#: Byte -> the byte it counts as: digits, letters in lower case and all bytes of characters
#: beyond ASCII stand for themselves, every other byte is 0.
FOLD = np.array([b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], np.uint8)
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: list = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, made once a worker."""
    if not _TABLES:
        _TABLES.extend([_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))])
    return _TABLES[0], _TABLES[1]


def word_spans(folded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of every word of a text whose bytes have been folded."""
    up, down = powers()
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(folded):
        to = min(at + PIECE, len(folded))
        if to < len(folded) and folded[to - 1] and folded[to]:  # end the piece between words if it has such a place
            gaps = np.flatnonzero(folded[at:to] == 0)
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(folded[to:] == 0)
                to = to + int(rest[0]) if len(rest) else len(folded)
        part = folded[at:to]
        inside = np.empty(len(part) + 2, bool)
        inside[0] = inside[-1] = False
        np.not_equal(part, 0, out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        s, e = edge[::2], edge[1::2]
        if len(part) > PIECE:  # one word of more than a piece
            hashes.append(np.array([int.from_bytes(hashlib.sha256(part[a:b].tobytes()).digest()[:8], "little") for a, b in zip(s, e)], np.uint64))
        else:
            run = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_VALUE[part] * up[:len(part)], out=run[1:])
            hashes.append(mix64((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = to
    if not starts:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


@dataclass
class Items:
    """Test items end to end: the words' hashes and bytes, and the suffixes that begin with a window."""

    words: np.ndarray
    raw: bytes          # the folded texts, end to end
    start: np.ndarray   # where each word's bytes lie in ``raw``
    end: np.ndarray
    item: np.ndarray    # item number of every word
    tests: np.ndarray   # words at which a window begins
    width: np.ndarray   # and that window's words
    ids: list

    @classmethod
    def of(cls, rows: list[tuple], width: int) -> Items:
        parts: list[tuple] = []
        raw, size, words = [], 0, 0
        for number, (_, value) in enumerate(rows):
            folded = FOLD[np.frombuffer((value or "").encode("utf-8"), np.uint8)]
            s, e, h = word_spans(folded)
            own = min(width, len(h))
            tests = np.arange(words, words + len(h) - own + 1) if own else np.empty(0, np.int64)
            parts.append((h, s + size, e + size, np.full(len(h), number), tests, np.full(len(tests), own)))
            raw.append(folded.tobytes())
            size, words = size + len(folded), words + len(h)
        of = lambda k, kind=np.int64: np.concatenate([np.empty(0, kind), *[p[k].astype(kind) for p in parts]])
        return cls(of(0, np.uint64), b"".join(raw), of(1), of(2), of(3), of(4), of(5), [r[0] for r in rows])


class SuffixArray:
    """Positions of a sequence of word ranks (0 stands between documents) in the order of the
    ranks that follow them, compared over ``depth`` words or more."""

    def __init__(self, ranks: np.ndarray, depth: int):
        self.ranks = np.append(ranks, 0)
        n = len(ranks)
        rank, deep = ranks.astype(np.int64), 1
        bits = max(n.bit_length(), int(rank.max(initial=0)).bit_length()) + 1
        fan = max(2, min(62 // bits, 3))
        order = np.argsort(rank)
        while deep < depth and n:
            key = rank.copy()
            for step in range(1, fan):
                key <<= bits
                shift = step * deep
                if shift < n:
                    key[:-shift] |= rank[shift:]
            order = np.argsort(key)
            sorted_key = key[order]
            new = np.ones(n, bool)
            np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            deep *= fan
            if new.all():
                break
        self.order = order

    def sign(self, at: np.ndarray, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Of the suffix at ``at`` against ``length`` of ``words`` from ``start``, row by row: -1 below, 0 begins with them, 1 above."""
        sign = np.zeros(len(at), np.int64)
        rows = np.arange(len(at))
        for step in range(int(length.max(initial=0))):
            rows = rows[length[rows] > step]
            mine = self.ranks[np.minimum(at[rows] + step, len(self.ranks) - 1)]
            theirs = words[start[rows] + step]
            other = mine != theirs
            sign[rows[other]] = np.where(mine[other] < theirs[other], -1, 1)
            rows = rows[~other]
            if not len(rows):
                break
        return sign

    def bounds(self, words: np.ndarray, start: np.ndarray, length: np.ndarray, upper: bool) -> np.ndarray:
        """Binary search: the first place whose suffix is not below those words (upper: is above them)."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.order))
        while (busy := np.flatnonzero(low < high)).size:
            mid = (low[busy] + high[busy]) >> 1
            sign = self.sign(self.order[mid], words, start[busy], length[busy])
            below = sign <= 0 if upper else sign < 0
            low[busy[below]] = mid[below] + 1
            high[busy[~below]] = mid[~below]
        return low


def search(shard: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(position, test) of every occurrence of a test suffix's window in a shard's word hashes (0 between documents)."""
    none = np.empty(0, np.int64)
    if not len(shard) or not len(items.tests):
        return none, none
    vocabulary, ranks = np.unique(np.append(shard, np.uint64(0)), return_inverse=True)
    place = np.minimum(np.searchsorted(vocabulary, items.words), len(vocabulary) - 1)
    known = np.where(vocabulary[place] == items.words, place, len(vocabulary))  # a word the shard lacks is above all of its words
    array = SuffixArray(ranks[:-1], int(items.width.max()))
    first = array.bounds(known, items.tests, items.width, upper=False)
    inside = np.flatnonzero(first < len(array.order))
    inside = inside[array.sign(array.order[first[inside]], known, items.tests[inside], items.width[inside]) == 0]
    last = array.bounds(known, items.tests[inside], items.width[inside], upper=True)
    counts = last - first[inside]
    owner = np.repeat(np.arange(len(inside)), counts)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return array.order[first[inside][owner] + offset], inside[owner]


#: What a document has gathered: covered runs of words, the items that hit it, its longest match.
STATE = "n_words long, runs array<struct<first:long,last:long>>, items array<string>, longest long"


def _merge(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs [first, last) joined where they touch or overlap."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > reach[:-1]
    starts = np.flatnonzero(new)
    return first[starts], np.maximum.reduceat(reach, starts) if len(starts) else reach


class Shard:
    """Documents end to end, until they are many enough to be searched."""

    def __init__(self, items: Items):
        self.items, self.parts, self.docs, self.size = items, [], [], 0

    def add(self, doc: int, folded: np.ndarray, first: int, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> None:
        self.docs.append((doc, folded, first, self.size, s, e))
        self.parts += [h, np.zeros(1, np.uint64)]
        self.size += len(h) + 1

    def hits(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(document, first words, last words, item words) of the windows that its bytes confirm."""
        if not self.size:
            return
        items = self.items
        where, test = search(np.concatenate(self.parts), items)
        owner = np.searchsorted(np.array([d[3] for d in self.docs]), where, side="right") - 1
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(len(self.docs) + 1))
        for number, (doc, folded, first, base, s, e) in enumerate(self.docs):
            mine = order[cut[number]:cut[number + 1]]
            if not len(mine):
                continue
            at, width, word = where[mine] - base, items.width[test[mine]], items.tests[test[mine]]
            fits = [all(folded[s[a + k]:e[a + k]].tobytes() == items.raw[items.start[t + k]:items.end[t + k]] for k in range(w))
                    for a, t, w in zip(at.tolist(), word.tolist(), width.tolist())]
            if any(fits):
                at = at[fits] + first
                yield doc, at, at + width[fits], word[fits]


def _judge_batch(texts: pa.Array, items: Items) -> tuple[np.ndarray, list, list, np.ndarray]:
    """For each text: number of words, covered runs, items' ids, longest match in words."""
    n = len(texts)
    n_words = np.zeros(n, np.int64)
    found: dict = {}
    shard = Shard(items)

    def flush() -> None:
        nonlocal shard
        for doc, first, last, test in shard.hits():
            found.setdefault(doc, []).append((first, last, test))
        shard = Shard(items)

    raw = texts.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.empty(0, np.uint8)
    lap = int(items.width.max(initial=1)) - 1  # neighbouring shards of one document share them, so each holds every window whole
    step = max(SHARD, 4 * lap)
    for doc in range(n):
        if offsets[doc] == offsets[doc + 1] or not texts[doc].is_valid:
            continue
        folded = FOLD[data[offsets[doc]:offsets[doc + 1]]]
        s, e, h = word_spans(folded)
        n_words[doc] = len(h)
        for first in range(0, len(h), step - lap):
            to = min(first + step, len(h))
            shard.add(doc, folded, first, s[first:to], e[first:to], h[first:to])
            if shard.size >= SHARD:
                flush()
            if to == len(h):
                break
    flush()
    runs: list = [[] for _ in range(n)]
    names: list = [[] for _ in range(n)]
    longest = np.zeros(n, np.int64)
    for doc, parts in found.items():
        first, last, test = (np.concatenate([p[k] for p in parts]) for k in range(3))
        names[doc] = sorted({str(items.ids[i]) for i in np.unique(items.item[test]).tolist() if items.ids[i] is not None})
        longest[doc] = _longest_match(first, last, test)
        first, last = _merge(first, last)
        runs[doc] = [{"first": a, "last": b} for a, b in zip(first.tolist(), last.tolist())]
    return n_words, runs, names, longest


def _longest_match(first: np.ndarray, last: np.ndarray, test: np.ndarray) -> int:
    """Words of the longest run that one item and the document share: windows that follow each
    other by one word in both are one match."""
    diagonal = first - test
    order = np.lexsort((first, diagonal))
    first, last, diagonal = first[order], last[order], diagonal[order]
    new = np.ones(len(first), bool)
    new[1:] = (diagonal[1:] != diagonal[:-1]) | (first[1:] > first[:-1] + 1)
    starts = np.flatnonzero(new)
    return int((np.maximum.reduceat(last, starts) - first[starts]).max())


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple]]:
    """The items in blocks of about ``limit`` bytes of text, one block at the driver at a time."""
    own = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text")).filter("text IS NOT NULL").distinct()
    total = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    many = -(-total // limit)
    if many > 1:
        own = write_table(own.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(many)).cast("int")), ["block"])
    for block in range(many):
        part = own.filter(F.col("block") == block) if many > 1 else own
        yield [(r["item"], r["text"]) for r in part.orderBy("item", "text").collect()]


def _judge(items):
    """The column function that searches texts for broadcast ``items``."""

    @F.arrow_udf(T.StructType.fromDDL(STATE))
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = items.value
        runs_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                n_words, runs, ids, longest = _judge_batch(batch.slice(at, SLICE), own)
                yield pa.StructArray.from_arrays(
                    [pa.array(n_words), pa.array(runs, runs_type), pa.array(ids, pa.list_(pa.string())), pa.array(longest)],
                    names=["n_words", "runs", "items", "longest"])

    return judge


def match_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, runs (covered runs of words, [first, last)), items (sorted ids of the
    items found) and longest (words of the longest verbatim match of at least a window)."""
    names = ("n_words", "runs", "items", "longest")
    out = docs.drop(*[n for n in names if n != text])
    (state,) = fresh(out, "__state")
    kind = T.StructType.fromDDL(STATE)
    first = True
    for rows in _blocks(benchmark, item_id, item_text, block_bytes):
        items = Items.of(rows, window)
        sent = docs.sparkSession.sparkContext.broadcast(items)

        found = _judge(sent)(F.col(text))
        if first:
            out = out.withColumn(state, found)
        else:  # what earlier blocks found stands in a written table
            (more,) = fresh(out, "__more")
            out = write_table(out).withColumn(more, found)
            out = out.withColumn(state, _united(F.col(state), F.col(more))).drop(more)
        first = False
    if first:  # no item: words are counted all the same
        pattern = F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
        out = out.withColumn(state, F.struct(
            F.coalesce(F.regexp_count(text, pattern), F.lit(0)).cast("long").alias("n_words"),
            F.array().cast(kind["runs"].dataType).alias("runs"), F.array().cast("array<string>").alias("items"),
            F.lit(0).cast("long").alias("longest")))
    return out.withColumns({n: F.col(f"{state}.{n}") for n in names}).drop(state)


def _united(a: Column, b: Column) -> Column:
    """What two blocks found, together."""
    runs = F.array_sort(F.concat(a["runs"], b["runs"]))
    joined = F.aggregate(runs, F.slice(runs, 1, 0), lambda acc, r: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["last"] >= r["first"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            F.try_element_at(acc, F.lit(-1))["first"].alias("first"),
            F.greatest(F.try_element_at(acc, F.lit(-1))["last"], r["last"]).alias("last"))))).otherwise(F.concat(acc, F.array(r))))
    return F.struct(a["n_words"].alias("n_words"), joined.alias("runs"),
                    F.array_sort(F.array_union(a["items"], b["items"])).alias("items"),
                    F.greatest(a["longest"], b["longest"]).alias("longest"))


def hit_words(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda acc, r: acc + r["last"] - r["first"])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark."""
    kept = match_benchmark(docs, benchmark, **options).filter(F.size("runs") == 0)
    return kept.select(*[c for c in docs.columns if c in kept.columns])
