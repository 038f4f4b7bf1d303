"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text is cut into words and runs of signs, case kept. Unigrams and bigrams of these
pieces, and one- to three-grams of the pieces' shapes (capitals, digits, signs, the same
as the piece before, ...), are hashed into a fixed number of weights. A document's score is
the logistic function of the sparse dot product of its n-gram counts, divided by the root of
their number, with the weights.

Fitting, on a bounded, hash-chosen sample of labelled documents: the sample is dealt to a
fixed number of shards; in each round every shard runs FTRL-Proximal over its documents in
hash order, starting from the shards' mean state. The state is two numbers a weight, a
fixed size, and all that the driver sees.

Cases: null and empty texts have no n-gram and score what the bias says; any length is
read whole; repeated rows score alike; null ids are scored; without labels of both
classes the bias alone learns; an empty table gives no rows; other columns pass through,
and an input column named like the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiatlas.llm.common import document_labels, hash_sample, mix64, ship
from apiatlas.session import write_table

ship(__name__)

#: Weights, as a power of two; the last one is the bias.
BITS = 18
#: At most about so many labelled documents are learned from.
SAMPLE = 20_000
SHARDS = 6
ROUNDS = 3
#: FTRL-Proximal: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01
PIECE = re.compile(r"\w+|[^\w\s]+")


def shape(piece: str) -> int:
    """A small number for what a piece looks like."""
    if piece.isalpha():
        if piece.islower():
            return 1 if len(piece) < 12 else 2
        if piece.isupper():
            return 3 if len(piece) > 1 else 4
        return 5 if piece[1:].islower() else 6
    if piece.isdigit():
        return 7
    if piece[0].isalnum() or piece[0] == "_":
        return 8
    return 9 if len(piece) == 1 else 10


class Pieces(dict):
    """Memo piece -> (hash << 8 | shape); emptied when full."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[piece] = value = (xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass")) >> 8 << 8) | shape(piece)
        return value

    def features(self, text: str | None) -> np.ndarray:
        """Indexes of all n-grams of a text, repeats included."""
        pieces = PIECE.findall(text) if text else []
        own = np.fromiter(map(self.__getitem__, pieces), np.uint64, len(pieces))
        if not len(own):
            return np.empty(0, np.int64)
        shapes = own & np.uint64(255)
        shapes[1:][own[1:] == own[:-1]] = 11  # the same piece again
        k = np.uint64(0x9E3779B97F4A7C15)
        grams = [own, own[:-1] * k + own[1:], shapes + np.uint64(1 << 40), shapes[:-1] * np.uint64(16) + shapes[1:] + np.uint64(1 << 41),
                 shapes[:-2] * np.uint64(256) + shapes[1:-1] * np.uint64(16) + shapes[2:] + np.uint64(1 << 42)]
        return (mix64(np.concatenate(grams)) >> np.uint64(64 - BITS)).astype(np.int64)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def probability(logit: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(logit, -35, 35))))


def learn(z: np.ndarray, n: np.ndarray, indexes: np.ndarray, y: int) -> None:
    """One FTRL-Proximal step on one document, in place."""
    at, counts = np.unique(indexes, return_counts=True)
    at, x = np.append(at, len(z) - 1), np.append(counts / np.sqrt(max(1, len(indexes))), 1.0)
    w = weights_of(z[at], n[at])
    g = (probability(float(w @ x)) - y) * x
    sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
    z[at] += g - sigma * w
    n[at] += g * g


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> np.ndarray:
    """Weights from ``labels`` (doc_id, y) and the texts of at most about ``sample`` of them."""
    spark = docs.sparkSession
    chosen = hash_sample(labels, F.col("doc_id"), sample, seed=4)
    order = F.xxhash64(F.lit(4), "doc_id", "text")
    known = write_table(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
                        .join(F.broadcast(chosen), "doc_id")
                        .select("text", "y", order.alias("at"), F.pmod(order, F.lit(SHARDS)).cast("int").alias("shard")))
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(ROUNDS):
        state = spark.sparkContext.broadcast((z, n))

        def train(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            z, n = (a.copy() for a in state.value)
            pieces = Pieces()
            seen = [(at, pieces.features(text), y) for t in tables
                    for at, text, y in zip(t.column("at").to_pylist(), t.column("text").to_pylist(), t.column("y").to_pylist())]
            for _, indexes, y in sorted(seen, key=lambda s: s[0]):
                learn(z, n, indexes, y)
            yield pa.record_batch([pa.array([z.astype(np.float32).tobytes()], pa.binary()),
                                   pa.array([n.astype(np.float32).tobytes()], pa.binary())], names=["z", "n"])

        shards = known.groupBy("shard").applyInArrow(train, "z binary, n binary")
        total_z, total_n, k = np.zeros(size), np.zeros(size), 0
        for row in shards.collect():  # a fixed number of rows of fixed size
            total_z += np.frombuffer(row["z"], np.float32)
            total_n += np.frombuffer(row["n"], np.float32)
            k += 1
        if not k:
            break
        z, n = total_z / k, total_n / k
    return weights_of(z, n)


def score_documents(docs: DataFrame, weights: np.ndarray, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, pieces = shared.value, Pieces()
        for batch in batches:
            out = []
            for value in batch:
                own = pieces.features(value.as_py())
                out.append(probability(float(w[own].sum()) / np.sqrt(max(1, len(own))) + w[-1]))
            yield pa.array(out, pa.float64())

    return docs.withColumn(score, judge(F.col(text)))


def quality_scores(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """Fit on the rows of ``labels`` (doc_id, quality) for which ``learn`` holds, score all of ``docs``."""
    known = labels if learn is None else labels.filter(learn)
    return score_documents(docs, fit(docs, document_labels(known, "quality")))
