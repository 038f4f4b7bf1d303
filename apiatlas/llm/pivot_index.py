"""Embedding near-duplicates by a pivot-permutation index.

Pivots are far from each other: out of a bounded, hash-chosen sample, its mean taken off, the vector
farthest from all pivots so far comes next. A vector is described by its nearest pivots in order.
The inverted lists are keyed by sets of shared pivots: two vectors meet in a list just if they have
that many of their nearest pivots in common. How many that are is fitted: sample vectors and copies
of them turned by the threshold's angle must share them in ``SURE`` of the cases. Each list is
verified in blocks of bounded size by exact cosines in double precision; a pair that meets in several
lists counts in the one of the shared pivots that rank first in both orders. Blocks give back a
number of links and a local component for each vector, never the pairs.

Equal vectors of a label are one class with a multiplicity, so copies cost nothing; a large
group of near copies is split into blocks that meet block by block.

Cases: vectors that are null, zero, or hold null or non-finite components, and rows with a
null label, link with nothing (their component is their own vec_id); vectors of different
lengths never link; rows with a null vec_id link with nothing and have a null component;
rows that repeat a vec_id are vectors of their own; an empty table gives no rows; other
columns are not carried. Classes go by 64-bit hashes of 128-bit digests of their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiatlas.llm.common import hash_sample, release, ship
from apiatlas.llm.components import connected_components
from apiatlas.session import write_table

ship(__name__)

THRESHOLD = 0.98
#: Pivots are chosen among about ``SAMPLE`` vectors; no two have a cosine above ``APART``, so a group of near
#: copies holds one of them and the others lie far enough to order.
SAMPLE, PIVOTS, APART = 4_000, 256, 0.6
#: Nearest pivots of a description, most of them that a list's members share, and the share of pairs at
#: the threshold that must share so many, and one at the least.
NEAREST, SHARED, SURE, LEAST = 6, 3, 0.97, 0.93
#: Vectors of a block, about.
BLOCK = 256
#: Lists of up to so many vectors are verified many at once; numbers held meanwhile, about.
SMALL, NUMBERS = 48, 1 << 22


def usable(vector: Column) -> Column:
    """Has a vector a direction: no null or non-finite component, not all zero?"""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Index:
    """Pivots for vectors of one length, and how many of them a list's members share. The sample's mean is
    taken off unless that hides pairs (as in one dense group, whose rest is noise)."""

    def __init__(self, sample: np.ndarray):
        tries: list = []
        for mean in (sample.mean(axis=0), np.zeros(sample.shape[1])):
            self.mean = mean
            self._choose(self._centred(sample))
            common = self._common(sample[:1000])
            tries += [(s, (common >= s).mean(), mean, self.pivots) for s in range(1, min(SHARED, len(self.pivots)) + 1)]
        # the most shared pivots that are sure enough, less the mean first; else one, where it is surer
        sure = [t for t in tries if t[1] >= SURE and (t[0] > 1 or t[2].any())] or [t for t in tries if t[0] == 1 and t[1] >= LEAST]
        self.shared, _, self.mean, self.pivots = max(sure, key=lambda t: (t[2].any(), t[0])) if sure else max(tries, key=lambda t: t[1])

    def _choose(self, x: np.ndarray) -> None:
        best, kept = x @ x[0], [0]
        while len(kept) < min(PIVOTS, len(x)) and best.min() <= APART:
            kept.append(int(best.argmin()))
            best = np.maximum(best, x @ x[kept[-1]])
        self.pivots = x[kept]

    def _centred(self, x: np.ndarray) -> np.ndarray:
        rest = x - self.mean
        size = np.sqrt((rest * rest).sum(axis=1, keepdims=True))
        return rest / np.where(size > 0, size, 1)

    def _common(self, x: np.ndarray) -> np.ndarray:
        """How many pivots vectors share with copies of them turned by the threshold's angle."""
        turn = np.random.default_rng(8).normal(size=x.shape)
        turn -= (turn * x).sum(axis=1, keepdims=True) * x
        size = np.sqrt((turn * turn).sum(axis=1, keepdims=True))
        near = self.nearest(THRESHOLD * x + (1 - THRESHOLD ** 2) ** 0.5 * turn / np.where(size > 0, size, 1))
        return (self.nearest(x)[:, :, None] == near[:, None, :]).any(axis=2).sum(axis=1)

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Each unit vector's nearest pivots, in order."""
        k = min(NEAREST, len(self.pivots))
        return np.argsort(-(self._centred(x) @ self.pivots.T), axis=1, kind="stable")[:, :k]


def fit_index(sample: DataFrame) -> dict[int, Index]:
    """Length -> index, from a bounded sample."""
    rows = sample.select("vector", F.xxhash64("vector").alias("at")).toPandas().sort_values("at")["vector"]  # bounded
    by_size: dict = {}
    for v in rows:
        by_size.setdefault(len(v), []).append(v)
    return {size: Index(unit(vectors)) for size, vectors in by_size.items()}


def describe(x: np.ndarray, index: Index | None) -> tuple[np.ndarray, int]:
    """Descriptions of unit vectors, and how many pivots lists share; none if no vector of that length was sampled."""
    return (index.nearest(x), index.shared) if index is not None else (np.zeros((len(x), 0), np.int64), 0)


def cell_of(pivots: np.ndarray, size: int) -> np.ndarray:
    """The list of each row's pivots (in rising order) for vectors of one length."""
    cell = np.full(len(pivots), size, np.int64)
    for c in range(pivots.shape[1]):
        cell = cell * (PIVOTS + 1) + pivots[:, c]
    return cell


def list_entries(reps: DataFrame, indexes) -> DataFrame:
    """(label, cell, id): the inverted lists that hold each vector."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cells = [], []
            vectors = batch.column(1).to_pylist()
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes).tolist() if len(sizes) else []:
                at = np.flatnonzero(sizes == size)
                order, shared = describe(unit([vectors[i] for i in at]), indexes.value.get(size))
                near = np.sort(order, axis=1)
                for some in combinations(range(near.shape[1]), shared):
                    ids.append(at)
                    cells.append(cell_of(near[:, list(some)], size))
            if ids:
                at = pa.array(np.concatenate(ids))
                yield pa.record_batch([batch.column(0).take(at), batch.column(2).take(at), pa.array(np.concatenate(cells))],
                                      names=["id", "label", "cell"])

    return reps.select("id", "vector", "label").mapInArrow(entries, "id long, label long, cell long")


def own_cell(one: np.ndarray, two: np.ndarray, shared: int, size: int) -> np.ndarray:
    """The list in which each pair of descriptions counts: the shared pivots that rank first in both
    orders (of equal ranks the lower number)."""
    ranks = np.arange(one.shape[1])
    same = one[:, :, None] == two[:, None, :]
    other = (same * ranks).sum(axis=2)
    score = np.where(same.any(axis=2), (ranks + other) * (PIVOTS + 1) + one, np.iinfo(np.int64).max)
    first = np.argsort(score, axis=1, kind="stable")[:, :shared]
    return cell_of(np.sort(np.take_along_axis(one, first, axis=1), axis=1), size)


def linked_pairs(x: np.ndarray, runs: np.ndarray, first: np.ndarray, across: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one run whose cosine reaches the threshold, in bounded slices. ``runs`` are the
    ends of the runs; where ``across`` only pairs between the two blocks count."""
    size = np.diff(runs, prepend=0)
    for small in (True, False):
        for k in np.flatnonzero(size > SMALL) if not small else (None,):
            if k is not None:  # a large list: one product of matrices
                lo, hi = int(runs[k] - size[k]), int(runs[k])
                hits = np.triu(x[lo:hi] @ x[lo:hi].T >= THRESHOLD, 1)
                if across[lo]:
                    hits &= first[lo:hi, None] != first[None, lo:hi]
                i, j = np.nonzero(hits)
                yield i + lo, j + lo
                continue
            end = np.repeat(np.where(size <= SMALL, runs, 0), size)
            later = np.maximum(end - np.arange(len(x)) - 1, 0)
            upto = np.cumsum(later)
            at = 0
            while at < len(x):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + NUMBERS // x.shape[1], side="right")))
                i = np.repeat(np.arange(at, to), later[at:to])
                j = i + 1 + np.arange(len(i)) - np.repeat(upto[at:to] - later[at:to] - (upto[at - 1] if at else 0), later[at:to])
                keep = ~across[i] | (first[i] != first[j])
                i, j = i[keep], j[keep]
                hit = np.einsum("ij,ij->i", x[i], x[j]) >= THRESHOLD
                yield i[hit], j[hit]
                at = to


def local_components(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Each row's smallest id reachable by the pairs (one, two)."""
    label = ids.copy()
    while len(one):
        low = label.copy()
        np.minimum.at(low, one, label[two])
        np.minimum.at(low, two, label[one])
        if (low == label).all():
            break
        label = low
    return label


KEYS = ["label", "cell", "one", "two"]


def block_links(blocks: DataFrame, indexes) -> DataFrame:
    """(id, links, low): for each block pair and vector the linked vectors, counted with
    their multiplicities, and the smallest id of its local component. Block pairs are dealt to tasks
    and sorted, so a task reads whole runs of rows and verifies many small lists at once."""

    def verify(rows: pa.Table) -> pa.RecordBatch:
        """Whole runs of vectors of one length."""
        flat = rows.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        keys = np.column_stack([rows.column(k).to_numpy() for k in KEYS])
        x = unit(flat.reshape(len(rows), -1))
        size = x.shape[1]
        order, shared = describe(x, indexes.value.get(size))
        ends = np.append(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys))
        ids, copies = rows.column("id").to_numpy(), rows.column("copies").to_numpy()
        count, found = np.zeros(len(ids), np.int64), []
        for i, j in linked_pairs(x, ends, rows.column("block").to_numpy() == keys[:, 2], keys[:, 2] != keys[:, 3]):
            own = own_cell(order[i], order[j], shared, size) == keys[i, 1]
            i, j = i[own], j[own]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            found.append((i, j))
        i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1)) if found else (np.empty(0, np.int64),) * 2
        low = local_components(i, j, ids)
        keep = count > 0
        return pa.record_batch([pa.array(ids[keep]), pa.array(count[keep]), pa.array(low[keep])], names=["id", "links", "low"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            keys = np.column_stack([rows.column(k).to_numpy() for k in KEYS])
            cut = len(rows) if last else int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1] + 1) if (keys != keys[-1]).any() else 0
            if cut < len(rows):  # the last run goes on in the next batch
                held.extend(rows.slice(cut).to_batches())
            rows = rows.slice(0, cut)
            sizes = pa.compute.list_value_length(rows.column("vector")).to_numpy() if cut else np.empty(0, np.int64)
            for size in np.unique(sizes):
                yield verify(rows.take(pa.array(np.flatnonzero(sizes == size))))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) >= 8 * NUMBERS:
                yield from whole(False)
        if held:
            yield from whole(True)
        release()

    dealt = blocks.select(*KEYS, "id", "block", "copies", "vector").repartition(*KEYS).sortWithinPartitions(*KEYS, "id")
    return dealt.mapInArrow(links, "id long, links long, low long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``."""
    spark = vectors.sparkSession
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                         F.col(embedding).cast("array<double>").alias("vector"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    marked = own.withColumns({"h1": F.when(fit, F.xxhash64("vector")), "h2": F.when(fit, F.xxhash64(F.lit(1), "vector"))})
    classes = write_table(marked.filter("h1 IS NOT NULL").groupBy("label", "h1", "h2").agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
        .withColumn("id", F.xxhash64("label", "h1", "h2")))
    indexes = spark.sparkContext.broadcast(fit_index(hash_sample(classes.select("vector"), F.col("vector"), SAMPLE, seed=8)))

    entries = write_table(list_entries(classes, indexes))
    sizes = entries.groupBy("label", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    placed = (entries.join(sizes, ["label", "cell"])
              .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
              .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("label", "cell", "id", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")))
    blocks = placed.join(classes.select("id", "copies", "vector"), "id")
    found = write_table(block_links(blocks, indexes))
    indexes.destroy()
    links = found.groupBy("id").agg(F.sum("links").alias("links"))

    comps = connected_components(found.select(F.col("id").alias("u"), F.col("low").alias("v")))
    judged = (classes.join(links, "id", "left").join(comps, F.col("id") == F.col("node"), "left")
              .select("label", "h1", "h2", "first_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                      F.coalesce("component", "id").alias("comp")))
    names = judged.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    judged = judged.join(names, "comp").drop("comp", "first_id")
    rows = marked.filter("h1 IS NOT NULL").join(judged, ["label", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = marked.filter("h1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return rows.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
