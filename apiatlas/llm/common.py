"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ship(module_name: str) -> None:
    """Pickle a module's functions by value, so Python workers on executors
    need this package neither installed nor on a shared disk."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship(__name__)

def release() -> None:
    """Give the memory that a task no longer uses back to the system. Spark keeps Python
    workers for later tasks, and what their allocators hold on to would add up over stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library may have none
    if trim:
        trim(0)


#: A word of every text contract here: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id's decimal text modulo ``n`` (null id: null)."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class WordHashes(dict):
    """Cache word (bytes) -> 64-bit hash; emptied when it reaches ``limit`` entries,
    so a task's memory stays bounded whatever the vocabulary."""

    def __init__(self, seed: int = 0, limit: int = 200_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = xxhash.xxh64_intdigest(word, self.seed)
        self[word] = value
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of every run of ``width`` consecutive word hashes, in order."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        out = out * factor + words[k:k + n]
    return mix64(out)


def hash_sample(df: DataFrame, key: Column, limit: int, seed: int) -> DataFrame:
    """At most about ``limit`` rows, chosen by a seeded hash of ``key``: all rows when there
    are no more than that, else the rows whose hash lies in the matching fraction of its
    range (the same rows on every run). The share is found by one count."""
    n = df.count()
    if n <= limit:
        return df
    buckets = 1 << 30
    return df.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(buckets)) < int(buckets * limit / n))


def document_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y): one 0/1 label for each doc_id. Null ids and null labels are left out;
    of several rows for one id the mean decides (0.5 and more: 1)."""
    return (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
            .groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("m"))
            .select("doc_id", (F.col("m") >= 0.5).cast("int").alias("y")))
