"""Toxic passages: maximum-scoring segments over token log-odds with Dirichlet priors.

Fitting (on a bounded, hash-chosen sample of labelled documents): words and their stems
(first letters) are counted per class; a word's log-odds between the classes carry a
Dirichlet prior centred on its stem's log-odds, a stem's on the shorter stem's, the
shortest on no difference. So a word that was never seen still scores as its stem does. A
token's score is its log-odds, at least 0, less a fixed drift, so ordinary text loses.

Scoring: a linear scan finds all maximal scoring segments of a document. Under the scores'
distribution in clean documents the best of m places exceeds S about K * m * exp(-lambda * S)
times (lambda from the score distribution, K from the clean documents' best segments). A
segment expected less than ``SIGNIFICANT`` times is a toxic passage; a document's evidence is
the sum of its segments' excess over that expectation, and a logistic curve fitted on
the sample turns it into the score.

Cases: null and empty texts hold no token and get the score of no evidence; any length is
read whole; repeated rows get equal scores; null ids score like others; without labels of
both classes all documents get the share of label 1 (0 without any); an empty table gives
no rows; other columns pass through, and input columns named like a result are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apiatlas.llm.common import document_labels, fresh, hash_sample, release, ship
from apiatlas.session import write_table

ship(__name__)

#: At most about so many labelled documents are learned from, chosen by a hash of their id.
SAMPLE = 20_000
#: Letters of a stem, shortest first, and the prior's strength in documents.
STEMS = (3, 4, 5)
STRENGTH = 10.0
#: Words that a counting task holds before it passes them on.
FLUSH = 100_000
#: What every token loses, so that segments end.
DRIFT = 1.0
#: A token enters the model when its score differs so much from its stem's.
APART = 0.2
#: A passage is significant if it is expected less often than this in clean text.
SIGNIFICANT = 0.05
TOKEN = re.compile(r"\w+")
RESULT = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("passages", T.ArrayType(T.StructType([
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
        T.StructField("score", T.DoubleType()), T.StructField("expected", T.DoubleType())])))])
PASSAGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))


class Scores(dict):
    """Memo token -> score: its own weight, else that of its longest known stem."""

    def __init__(self, weights: dict, limit: int = 150_000):
        super().__init__()
        self.weights, self.limit = weights, limit

    def __missing__(self, token: str) -> float:
        found = self.weights.get(token + " ")  # a word ends in a blank, a stem doesn't
        if found is None:
            found = next((w for n in reversed(STEMS) if (w := self.weights.get(token[:n])) is not None), 0.0)
        if len(self) >= self.limit:
            self.clear()
        self[token] = value = max(found, 0.0) - DRIFT
        return value

    def of(self, text: str | None) -> np.ndarray:
        tokens = TOKEN.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, tokens), np.float64, len(tokens))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score), from left to right, in linear
    time. A segment is kept with the sums before and up to it; a new place joins the kept
    segments back to the nearest one that starts lower, as long as that one ends lower too.
    Each kept segment remembers where that search ended for itself, so none is walked twice."""
    places = np.flatnonzero(scores > 0)
    if not len(places):
        return []
    sums = np.cumsum(scores)
    kept: list[list] = []  # first, end, sum before, sum up to, index of the nearest lower start
    for i in places.tolist():
        first, before, upto = i, float(sums[i] - scores[i]), float(sums[i])
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= upto:
                kept.append([first, i + 1, before, upto, j])
                break
            first, before = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, upto - before) for a, b, before, upto, _ in kept]


def token_counts(sample: DataFrame) -> DataFrame:
    """(token, t, n): the toxic and the other documents that hold a word (a word that one
    document repeats tells no more about others)."""

    def rows(both: tuple) -> pa.RecordBatch:
        words = [*(both[0].keys() | both[1].keys())]
        return pa.record_batch([pa.array(words, pa.string()), pa.array([both[1][w] for w in words], pa.int64()),
                                pa.array([both[0][w] for w in words], pa.int64())], names=["token", "t", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                if (text := text.as_py()) is not None:
                    both[y].update(set(TOKEN.findall(text.lower())))
                if len(both[0]) + len(both[1]) > FLUSH:  # counts are added up behind: a task holds no more words
                    yield rows(both)
                    both = Counter(), Counter()
        yield rows(both)

    return (sample.select("text", "y").mapInArrow(count, "token string, t long, n long")
            .groupBy("token").agg(F.sum("t").alias("t"), F.sum("n").alias("n")))


def log_odds(counts: DataFrame, total_t: float, total_n: float) -> dict:
    """Token -> log-odds for the stems and words that differ from what their stem says."""
    ratio = total_t / total_n

    def posterior(t: Column, n: Column, parent: Column) -> Column:
        share = F.lit(ratio) * F.exp(parent) / (1 + F.lit(ratio) * F.exp(parent))
        return F.log((t + STRENGTH * share) / (n + STRENGTH * (1 - share))) - F.log(F.lit(ratio))

    levels, above = [], None
    for n in STEMS:
        stem = counts.groupBy(F.substring("token", 1, n).alias("token")).agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
        if above is None:
            now = stem.withColumn("parent", F.lit(0.0))
        else:
            now = stem.join(above, F.substring("token", 1, STEMS[len(levels) - 1]) == F.col("up")).drop("up")
        now = now.withColumn("w", posterior(F.col("t"), F.col("n"), F.col("parent")))
        levels.append(now.select("token", "parent", "w"))
        above = now.select(F.col("token").alias("up"), F.col("w").alias("parent"))
    words = counts.join(above, F.substring("token", 1, STEMS[-1]) == F.col("up")).withColumn(
        "w", posterior(F.col("t"), F.col("n"), F.col("parent"))).select(F.concat("token", F.lit(" ")).alias("token"), "parent", "w")
    every = levels[0]
    for level in [*levels[1:], words]:
        every = every.union(level)
    # only a token held by several toxic documents' worth of evidence gets this far from its
    # stem, so the model is bounded by the sample
    gap = F.abs(F.greatest("w", F.lit(0.0)) - F.greatest("parent", F.lit(0.0))) > APART
    return {r["token"]: r["w"] for r in every.filter(gap).collect()}


class Model:
    """What scoring needs: token weights, lambda, ln K and the logistic curve."""

    def __init__(self, weights: dict, rate: float = 0.0):
        self.weights, self.rate = weights, rate
        self.decay, self.log_k, self.slope, self.offset = 1.0, 0.0, 0.0, 0.0

    def excess(self, segments: list, m: int) -> list[float]:
        """Each segment's -ln(expected number of such segments)."""
        return [self.decay * s - self.log_k - np.log(m) for _, _, s in segments]

    def evidence(self, scores: np.ndarray) -> float:
        return float(sum(max(0.0, x) for x in self.excess(maximal_segments(scores), max(1, len(scores)))))

    def score(self, evidence: float) -> float:
        if not self.weights:
            return self.rate
        return float(1 / (1 + np.exp(-np.clip(self.slope * np.log1p(evidence) + self.offset, -30, 30))))


def _decay(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive lambda with sum(share * exp(lambda * score)) = 1; without any positive
    score in clean text, that of log-odds themselves, 1."""
    def over(x: float) -> float:
        return float(np.sum(shares * np.exp(x * values))) - 1
    if not np.any((values > 0) & (shares > 0)) or float(values @ shares) >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while over(high) < 0 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a lightly damped logistic curve, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - 1e-3 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from ``labels`` (doc_id, y) and the texts of at most about ``sample`` of them."""
    chosen = hash_sample(labels, F.col("doc_id"), sample, seed=5)
    known = write_table(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
                        .join(F.broadcast(chosen), "doc_id").select("text", "y"))
    counts = write_table(token_counts(known))
    total_t, total_n = counts.agg(F.sum("t"), F.sum("n")).first()
    if not total_t or not total_n:
        rate = known.agg(F.avg("y")).first()[0]
        return Model({}, float(rate or 0.0))
    model = Model(log_odds(counts, float(total_t), float(total_n)))
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(shared.value)
        for batch in batches:
            out = []
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                own = scores.of(text.as_py())
                found = [s for _, _, s in maximal_segments(own)]
                values, n = np.unique(np.round(own, 2), return_counts=True)
                out.append((y, len(own), found, values.tolist(), n.tolist()))
            yield pa.record_batch([pa.array([o[k] for o in out], kind) for k, kind in enumerate(
                (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())))],
                names=["y", "m", "found", "value", "k"])
        scores = batch = out = None
        release()

    seen = write_table(known.mapInArrow(best, "y int, m long, found array<double>, value array<double>, k array<long>"))
    clean = seen.filter("y = 0")
    spread = clean.select(F.explode(F.arrays_zip("value", "k")).alias("z")).groupBy("z.value").agg(F.sum("z.k").alias("k")).toPandas()
    if len(spread):
        model.decay = _decay(spread["value"].to_numpy(), (spread["k"] / spread["k"].sum()).to_numpy())
    places = F.log(F.greatest("m", F.lit(1)).cast("double"))
    top = F.coalesce(F.array_max("found"), F.lit(0.0))
    mean = clean.filter("m > 1").agg(F.avg(F.lit(model.decay) * top - places)).first()[0]
    if mean is not None:  # the Gumbel law's mean: ln K + Euler's constant
        model.log_k = float(mean) - 0.5772156649015329
    evidence = F.aggregate("found", F.lit(0.0), lambda acc, s: acc + F.greatest(
        F.lit(0.0), F.lit(model.decay) * s - F.lit(model.log_k) - places))
    # two numbers for each sampled document, so the sample's size bounds what comes to the driver
    rows = seen.select("y", F.log1p(evidence).alias("x")).toPandas().sort_values(["x", "y"])
    model.slope, model.offset = _logistic(rows["x"].to_numpy(), rows["y"].to_numpy().astype(float))
    shared.destroy()
    return model


def score_documents(docs: DataFrame, model: Model, text: str = "text",
                    score: str = "score", passages: str = "passages") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``passages``: each significant passage's first
    character, the one behind its last, its score and how often clean text would hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        scores = Scores(model.weights)
        for batch in batches:
            points, spans = [], []
            for value in batch:
                value = value.as_py()
                own = scores.of(value)
                found = maximal_segments(own)
                excess = model.excess(found, max(1, len(own)))
                points.append(model.score(sum(max(0.0, x) for x in excess)))
                toxic = [(s, x) for s, x in zip(found, excess) if x > -np.log(SIGNIFICANT)]
                if toxic:
                    low = value.lower()
                    at = [t.span() for t in TOKEN.finditer(low)]
                    spans.append([{"start": at[a][0], "end": at[b - 1][1], "score": s, "expected": float(np.exp(-x))}
                                  for (a, b, s), x in toxic])
                else:
                    spans.append([])
            yield pa.StructArray.from_arrays([pa.array(points, pa.float64()), pa.array(spans, PASSAGES)], names=["score", "passages"])
        scores = batch = points = spans = None
        release()

    (tmp,) = fresh(docs, "__toxic")
    out = docs.withColumn(tmp, judge(F.col(text)))
    return out.withColumns({score: F.col(f"{tmp}.score"), passages: F.col(f"{tmp}.passages")}).drop(tmp)


def toxicity_scores(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """Fit on the rows of ``labels`` (doc_id, toxic) for which ``learn`` holds, score all of ``docs``."""
    known = labels if learn is None else labels.filter(learn)
    return score_documents(docs, fit(docs, document_labels(known, "toxic")))
