"""Quality rules: gradient-boosted trees over document statistics.

One pass over the texts takes each document's statistics: the base counts of the rules,
and ratios of them and of character classes. Trees are fitted on a bounded, hash-chosen
sample of labelled rows of that (narrow) table by histograms of the second-order gain, with
monotonic constraints: in the features named in ``MONOTONE`` more of the feature can only
lower the score. A split that breaks the order is refused, and each side's subtree is held
to its side of the middle of the two values. The fitted trees are flattened into arrays
(feature, threshold, left, right, value) that score whole batches level by level.

Words are runs without ASCII white space. Windows of eight words are told apart by 64-bit
hashes.

Cases: null and empty texts have all counts 0 (and fail the base rule of 20 words); any
length is read whole; repeated rows are judged alike; rows with a null id are judged, not
learned from; without labels of both classes the trees keep every document that the base
rules keep; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiatlas.llm.common import WordHashes, document_labels, hash_sample, ship, window_hashes
from apiatlas.session import write_table

ship(__name__)

SPACE = np.array([0x20, *range(0x09, 0x0E)])
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
WIDTH = 8
#: Base rules: at least so many words, at most this percentage of them in repeated windows.
MIN_WORDS, MAX_REPEAT = 20, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
            "sign_share", "distinct_share", "mean_line", "same_next_share", "sign_end_share")
#: The score never rises with these.
MONOTONE = ("symbol_share", "dup_line_share", "repeat_share", "same_next_share")
#: At most about so many labelled rows are learned from.
SAMPLE = 20_000
TREES, DEPTH, RATE, BINS, LEAST = 40, 4, 0.3, 64, 20.0


def statistics(text: bytes | None, hashes: WordHashes) -> tuple:
    """The five counts, then the features."""
    raw = text or b""
    signs = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    points = int(signs[:0x80].sum() + signs[0xC0:].sum())
    chars = points - int(signs[SPACE].sum())
    symbols = int(signs[SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]  # strips just the ASCII white space
    dup = len(lines) - len(set(lines))
    own = hashes.of(words)
    repeat = 0
    if n >= WIDTH:
        windows = window_hashes(own, WIDTH)
        _, group, size = np.unique(windows, return_inverse=True, return_counts=True)
        if len(size) < len(windows):
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(size[group] > 1)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WIDTH, -1)
            repeat = int(np.count_nonzero(np.cumsum(edge[:n]) > 0))
    letters = max(1, int(signs[65:91].sum() + signs[97:123].sum()))
    other = int(signs[33:48].sum() + signs[58:65].sum() + signs[91:97].sum() + signs[123:127].sum())
    ends = sum(1 for w in words if not (w[-1:].isalnum() or w[-1] >= 0x80 or w[-1:] in b".,"))
    k, c = max(1, n), max(1, chars)
    features = (np.log1p(n), chars / k, symbols / c, dup / max(1, len(lines)), repeat / k, int(signs[65:91].sum()) / letters,
                int(signs[48:58].sum()) / c, other / c, len(set(words)) / k, n / max(1, len(lines)),
                int(np.count_nonzero(own[1:] == own[:-1])) / k, ends / k)
    return (n, chars, symbols, dup, repeat, *map(float, features))


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, the counts, the features), one row for each row of ``docs``."""
    names = ["doc_id", *COUNTS, *FEATURES]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = [statistics(t.as_py(), hashes) for t in batch.column(1)]
            cols = [pa.array([r[k] for r in rows], pa.int64() if k < len(COUNTS) else pa.float64())
                    for k in range(len(COUNTS) + len(FEATURES))]
            yield pa.record_batch([batch.column(0), *cols], names=names)

    kind = ", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in FEATURES])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(
        measure, f"doc_id long, {kind}")


class Trees:
    """Flattened trees: node k tests ``feature[k] <= threshold[k]`` and goes to ``left[k]``
    or ``right[k]``; a leaf leads to itself."""

    def __init__(self, base: float):
        self.base, self.roots = base, []
        self.feature, self.threshold, self.left, self.right, self.value = [], [], [], [], []

    def leaf(self, value: float) -> int:
        k = len(self.value)
        for a, x in ((self.feature, 0), (self.threshold, np.inf), (self.left, k), (self.right, k), (self.value, value)):
            a.append(x)
        return k

    def packed(self) -> Trees:
        for name in ("feature", "left", "right", "roots"):
            setattr(self, name, np.array(getattr(self, name), np.int64))
        for name in ("threshold", "value"):
            setattr(self, name, np.array(getattr(self, name), np.float64))
        return self

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Scores of the rows of ``x``: all rows and trees step down together."""
        if not len(self.roots):
            return np.full(len(x), self.base)
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)


def _grow(trees: Trees, binned: np.ndarray, edges: list, g: np.ndarray, h: np.ndarray, rows: np.ndarray,
          depth: int, low: float, high: float) -> int:
    """Grow one subtree on ``rows``, its values within [low, high]; the root's number."""
    def worth(a, b):
        return np.clip(-a / (b + 1.0), low, high)

    def gain(a, b, v):  # of the value v for gradient sum a and second-order sum b
        return -(a * v + 0.5 * (b + 1.0) * v * v)

    total_g, total_h = g[rows].sum(), h[rows].sum()
    value = float(worth(total_g, total_h))
    if depth == 0 or total_h < 2e-3 * LEAST or len(rows) < 2 * LEAST:
        return trees.leaf(RATE * value)
    best = (1e-6, None)
    for f in range(binned.shape[1]):
        own = binned[rows, f]
        sum_g = np.cumsum(np.bincount(own, g[rows], BINS))[:-1]
        sum_h = np.cumsum(np.bincount(own, h[rows], BINS))[:-1]
        count = np.cumsum(np.bincount(own, minlength=BINS))[:-1]
        left, right = worth(sum_g, sum_h), worth(total_g - sum_g, total_h - sum_h)
        won = gain(sum_g, sum_h, left) + gain(total_g - sum_g, total_h - sum_h, right) - gain(total_g, total_h, value)
        won[(count < LEAST) | (len(rows) - count < LEAST)] = -np.inf
        if FEATURES[f] in MONOTONE:
            won[left < right] = -np.inf
        k = int(np.argmax(won))
        if won[k] > best[0]:
            best = (won[k], (f, k, float(left[k]), float(right[k])))
    if best[1] is None:
        return trees.leaf(RATE * value)
    f, k, left, right = best[1]
    middle = (left + right) / 2
    bounds = ((middle, high), (low, middle)) if FEATURES[f] in MONOTONE else ((low, high), (low, high))
    node = trees.leaf(0.0)
    goes = binned[rows, f] <= k
    trees.feature[node], trees.threshold[node] = f, edges[f][k]
    trees.left[node] = _grow(trees, binned, edges, g, h, rows[goes], depth - 1, *bounds[0])
    trees.right[node] = _grow(trees, binned, edges, g, h, rows[~goes], depth - 1, *bounds[1])
    return node


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for P(y = 1); without both classes none, and a base that keeps all."""
    if not len(y) or y.min() == y.max():
        return Trees(1.0).packed()
    rate = y.mean()
    trees = Trees(float(np.log(rate / (1 - rate))))
    edges = [np.concatenate([np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])), [np.inf]]) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    edges = [np.pad(e, (0, BINS - len(e)), constant_values=np.inf) for e in edges]
    logit = np.full(len(y), trees.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        one = Trees(0.0)
        root = _grow(one, binned, edges, p - y, p * (1 - p), np.arange(len(y)), DEPTH, -np.inf, np.inf)
        shift = len(trees.value)
        trees.roots.append(root + shift)
        for name in ("feature", "threshold", "value"):
            getattr(trees, name).extend(getattr(one, name))
        trees.left.extend(v + shift for v in one.left)
        trees.right.extend(v + shift for v in one.right)
        one.roots = [root]
        logit += one.packed().logits(x)
    return trees.packed()


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          learn: Column | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, the counts, base_failed, quality, kept): ``quality`` is the trees' probability
    of label 1; documents below 0.5 or failing a base rule are not kept."""
    stats = write_table(document_statistics(docs, doc_id, text))
    known = document_labels(labels if learn is None else labels.filter(learn), "quality")
    chosen = hash_sample(known, F.col("doc_id"), sample, seed=7)
    seen = stats.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", *FEATURES).toPandas()  # bounded by the sample
    seen = seen.sort_values(["doc_id", *FEATURES])
    trees = fit_trees(seen[[*FEATURES]].to_numpy(np.float64), seen["y"].to_numpy(np.float64))
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("double")
    def probability(*columns: pa.Array) -> pa.Array:
        x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns])
        return pa.array(1 / (1 + np.exp(-shared.value.logits(x))))

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return (stats.withColumn("quality", probability(*FEATURES))
            .select("doc_id", *COUNTS, failed.alias("base_failed"), "quality", (~failed & (F.col("quality") >= 0.5)).alias("kept")))
