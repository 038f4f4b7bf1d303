"""Byte-pair encoding and decoding by forced-boundary splitting.

A pair of neighbouring symbols that stands inside no vocabulary token can never be
crossed by a merge, so the place between the two is a certain cut. A pre-token is cut
at all such places, the fragments are encoded each for itself (and remembered: short
fragments repeat far more often than words), and their ids are concatenated.

Cases: null and empty text give no ids and the empty text; texts of any length are
encoded whole; repeated rows each get their own result; an empty table gives no rows; the
strings of the vocabulary's special tokens become those tokens, as in the library; other
columns pass through untouched, but input columns named as the two results are replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apiatlas.llm.common import fresh, release, ship

ship(__name__)

END = "</w>"
#: Documents whose results are built and sent at once.
SLICE = 128
#: Runs of characters whose ids a task remembers, in each of two generations.
REMEMBER = 240_000
RESULT = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 bytes stand for themselves, the others take 256, 257, ... in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def load_spec(path: str) -> dict:
    """The parts of a tokenizer file that encoding needs, read on the driver (the
    file's size is fixed) and broadcast. Refuses files built another way."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    if model["type"] != "BPE" or model["end_of_word_suffix"] != END or kinds != ["NFC", "Replace", "Lowercase"]:
        raise ValueError("expected a byte-level BPE vocabulary with word ends, NFC and lower case")
    split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {"vocab": model["vocab"], "merges": [tuple(m) for m in model["merges"]],
            "pattern": split["pattern"]["Regex"],
            "special": {t["content"]: t["id"] for t in spec["added_tokens"]}}


def split_symbols(token: str) -> list[str]:
    """A token's symbols; the word end belongs to the last one. A text's own "</w>" can't be
    taken for it: pre-tokens hold letters or signs, never both."""
    if token.endswith(END) and len(token) > len(END):
        stem = token[:-len(END)]
        return [*stem[:-1], stem[-1] + END]
    return [*token]


class Memo(dict):
    """Remembers ``make(key)`` for keys up to 64 characters, in two generations of ``limit``
    entries: when the young one is full it becomes the old one, and what is asked for again
    comes back from there. So frequent words stay and memory is bounded."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder over one vocabulary. ``remember`` bounds the memo of whole runs, the
    memos of their parts hold a third of it each; an entry takes some hundred bytes at most."""

    def __init__(self, spec: dict, remember: int = REMEMBER):
        self.vocab = spec["vocab"]
        self.ranks: dict = {}
        for rank, (left, right) in enumerate(spec["merges"]):
            self.ranks.setdefault(left, {})[right] = rank
        self.pattern = regex.compile(spec["pattern"])
        self.special = spec["special"]
        self.special_split = (re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
                              if self.special else None)
        self.symbols = dict(enumerate(byte_symbols()))
        self.inside = self._inner_pairs()
        self.texts = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.packed = {t: struct.pack("<I", i) for t, i in self.vocab.items()}
        self.fragments = Memo(self._merge, remember // 3)
        self.pretokens = Memo(self._pretoken, remember // 3)
        self.chunks = Memo(self._chunk, remember)

    def _inner_pairs(self) -> dict:
        """Left symbol -> the symbols that follow it inside some token. The last symbol of a
        word-final token carries the word end, as it does before any merge."""
        pairs: dict = {}
        for token in self.vocab:
            parts = split_symbols(token)
            for left, right in zip(parts, parts[1:]):
                pairs.setdefault(left, set()).add(right)
        return pairs

    def _merge(self, fragment: str) -> bytes:
        """Ids of one fragment: always the lowest-ranked pair, the leftmost of equals."""
        parts, ranks, none = split_symbols(fragment), self.ranks, 1 << 40
        if len(parts) > 24:
            parts = self._merge_long(parts)
        else:
            nothing: dict = {}
            near = [ranks.get(a, nothing).get(b, none) for a, b in zip(parts, parts[1:])]
            while near and (rank := min(near)) != none:
                at = near.index(rank)
                joined = parts[at] + parts.pop(at + 1)
                parts[at] = joined
                del near[at]
                if at:
                    near[at - 1] = ranks.get(parts[at - 1], nothing).get(joined, none)
                if at < len(near):
                    near[at] = ranks.get(joined, nothing).get(parts[at + 1], none)
        return b"".join([self.packed[p] for p in parts if p in self.packed])

    def _merge_long(self, parts: list) -> list:
        """The same merges through a heap and linked neighbours: n log n for long fragments."""
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]

        def rank(i: int):
            return self.ranks.get(parts[i], {}).get(parts[after[i]])

        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if parts[i] != a or after[i] < 0 or parts[after[i]] != b:
                continue
            parts[i], parts[after[i]] = a + b, None
            after[i] = after[after[i]]
            if after[i] >= 0:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (r := rank(left)) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[after[left]]))
        return [p for p in parts if p is not None]

    def _pretoken(self, token: str) -> bytes:
        """Cut at every pair that no token holds, encode the fragments, concatenate."""
        parts = [*map(self.symbols.__getitem__, token.encode("utf-8"))]
        parts[-1] += END
        inside = self.inside
        cuts = [i for i, (a, b) in enumerate(zip(parts, parts[1:]), 1) if a not in inside or b not in inside[a]]
        if not cuts:  # the pre-token itself is remembered
            return self._merge("".join(parts))
        return b"".join(self.fragments["".join(parts[a:b])] for a, b in zip([0, *cuts], [*cuts, len(parts)]))

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run without spaces or line ends: no pre-token and no composed
        character crosses those, so runs are independent."""
        if chunk.isascii():
            norm = chunk.lower()
        else:  # the library lower-cases each character for itself: no final sigma
            norm = "".join(map(str.lower, unicodedata.normalize("NFC", chunk)))
        if norm.isalpha():  # one run of letters is one pre-token
            return self.pretokens[norm]
        return b"".join(map(self.pretokens.__getitem__, self.pattern.findall(norm)))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return b"".join(struct.pack("<I", self.special[p]) if p in self.special else self._plain(p)
                            for p in self.special_split.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))

    def decode(self, ids: bytes) -> str:
        """The tokens' own texts with one space between, as a tokenizer without a decoder gives."""
        return " ".join(map(self.texts.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


def encode_decode(df: DataFrame, vocabulary: str, text: Column | None = None,
                  ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with ``ids`` (binary: the text's token ids as little-endian unsigned 32-bit
    integers, the layout of token shards) and ``decoded`` (the text of those ids).
    ``vocabulary`` is a file the driver reads. A narrow job: no shuffle."""
    spec = df.sparkSession.sparkContext.broadcast(load_spec(vocabulary))

    @F.arrow_udf(RESULT)
    def codec(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Codec(spec.value)
        for batch in batches:
            for at in range(0, len(batch), SLICE):  # the results of one slice are all that a task holds
                packed = [own.encode(value.as_py()) for value in batch.slice(at, SLICE)]
                yield pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(map(own.decode, packed), pa.string())],
                                                 names=["ids", "decoded"])
        own = packed = batch = None
        release()

    (tmp,) = fresh(df, "__bpe")
    out = df.withColumn(tmp, codec(F.col("text") if text is None else text))
    return out.withColumns({ids: F.col(f"{tmp}.ids"), decoded: F.col(f"{tmp}.decoded")}).drop(tmp)


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
