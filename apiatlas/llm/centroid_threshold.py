"""Centroid clustering, with nearest centroids found by the threshold algorithm.

The centroids are sorted once for each dimension. A vector walks every dimension's list
outward from its own value; a centroid met for the first time gets its exact distance, and
the walk ends when the sum over the dimensions of the squared distances to the lists'
frontiers strictly exceeds the best exact distance: no centroid unmet so far can then be
nearer, or as near with a smaller number. Vectors are whole numbers on a grid, so every
distance, sum and mean is exact.

A round is one pass: each task gives one row of sums for each centroid, Spark adds them up,
and ``k`` times ``dims`` sums reach the driver whatever the number of vectors.

Cases: vectors that are null, of another length, or hold null or non-finite components are
left out; rows that repeat an id are vectors of their own; a null id is clustered, but is the
last to become a starting centroid; equal starting hashes go by the vectors' components; with
fewer than ``k`` vectors there are as many centroids as vectors, and an empty table gives no
rows; centroids may be equal (the smaller number wins); other columns are not carried. A
component of 2^27 grid steps or more stops the job: distances would not fit 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiatlas.llm.common import ship
from apiatlas.session import write_table

ship(__name__)

#: Grid steps of one unit, and the first number of steps that is too large.
SCALE, TOO_FAR = 1024, 1 << 27
#: Vectors that walk at once.
SLICE = 2048


class Lists:
    """The centroids' sorted lists: for each dimension the values in order and whose they are."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = np.array(centroids, np.int64)
        order = np.argsort(self.centroids, axis=0, kind="stable")
        self.owner = order.T.copy()
        self.value = np.take_along_axis(self.centroids, order, axis=0).T.copy()

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to each row's nearest centroid."""
        n, dims = x.shape
        k = len(self.centroids)
        high = np.empty((n, dims), np.int64)  # the next list place above, and below it the next one down
        for d in range(dims):
            high[:, d] = np.searchsorted(self.value[d], x[:, d])
        low = high - 1
        best = np.full(n, np.iinfo(np.int64).max)
        number = np.full(n, k)
        met = np.zeros((n, k), bool)
        rows, across = np.arange(n), np.arange(dims)
        far = np.iinfo(np.int64).max
        for _ in range(k):
            own = x[rows]
            lo, hi = low[rows], high[rows]
            down = np.where(lo >= 0, own - self.value[across, np.maximum(lo, 0)], far)
            up = np.where(hi < k, self.value[across, np.minimum(hi, k - 1)] - own, far)
            lower = down <= up
            step = np.minimum(down, up)
            owner = self.owner[across, np.where(lower, np.maximum(lo, 0), np.minimum(hi, k - 1))]
            low[rows] = lo - lower
            high[rows] = hi + ~lower
            fresh = np.zeros((len(rows), k), bool)
            fresh[np.arange(len(rows))[:, None], owner] = True
            fresh &= ~met[rows]
            met[rows] |= fresh
            for c in np.flatnonzero(fresh.any(axis=0)).tolist():
                at = rows[fresh[:, c]]
                gap = x[at] - self.centroids[c]
                distance = np.einsum("ij,ij->i", gap, gap)
                nearer = (distance < best[at]) | (distance == best[at]) & (c < number[at])
                best[at[nearer]], number[at[nearer]] = distance[nearer], c
            rows = rows[(step * step).sum(axis=1) <= best[rows]]
            if not len(rows):
                break
        return number, best


def grid(vectors: DataFrame, vec_id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, x): the vectors that count, as whole grid steps."""
    v = F.col(embedding)
    fine = (F.size(v) == dims) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))))
    steps = F.transform(v, lambda e: F.floor(e.cast("double") * scale))
    held = F.when(F.forall(v, lambda e: F.abs(e.cast("double") * scale) < TOO_FAR), steps.cast("array<int>")).otherwise(
        F.raise_error(F.lit(f"a component reaches {TOO_FAR} steps")))
    return vectors.filter(v.isNotNull() & fine).select(F.col(vec_id).alias("vec_id"), held.alias("x"))


def first_centroids(points: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors of the smallest sha256 of ``seed:id``, in that order."""
    hashed = points.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    return [list(r["x"]) for r in hashed.orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def round_sums(points: DataFrame, centroids: list[list[int]], dims: int) -> dict[int, tuple[int, list[int]]]:
    """Centroid -> (number of its vectors, their sums by dimension), after one pass."""
    lists = points.sparkSession.sparkContext.broadcast(Lists(centroids))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, k = lists.value, len(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                x = matrix(batch.column(0).slice(at, SLICE), dims)
                number, _ = own.nearest(x)
                count += np.bincount(number, minlength=k)
                for c in np.unique(number):
                    total[c] += x[number == c].sum(axis=0)
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(some), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))],
                              names=["c", "n", "total"])

    parts = points.select("x").mapInArrow(sums, "c long, n long, total array<long>")
    wide = parts.select("c", "n", F.posexplode("total").alias("d", "s")).groupBy("c", "d").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict = {}
    for r in wide.collect():  # k times dims rows
        n, row = out.setdefault(r["c"], (int(r["n"]), [0] * dims))
        row[r["d"]] = int(r["s"])
    lists.destroy()
    return out


def assign(points: DataFrame, centroids: list[list[int]], dims: int) -> DataFrame:
    """(vec_id, cluster, distance): every vector's nearest centroid."""
    lists = points.sparkSession.sparkContext.broadcast(Lists(centroids))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                number, distance = lists.value.nearest(matrix(part.column(1), dims))
                yield pa.record_batch([part.column(0), pa.array(number.astype(np.int32)), pa.array(distance)],
                                      names=["vec_id", "cluster", "distance"])

    kind = points.schema["vec_id"].dataType.simpleString()
    out = write_table(points.select("vec_id", "x").mapInArrow(nearest, f"vec_id {kind}, cluster int, distance long"))
    lists.destroy()
    return out


def cluster(vectors: DataFrame, k: int, rounds: int, seed: int, dims: int, vec_id: str = "vec_id",
            embedding: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance), final centroids) after ``rounds`` rounds of assigning
    every vector and replacing every non-empty centroid by the floor of its vectors' mean."""
    points = write_table(grid(vectors, vec_id, embedding, dims, scale))
    centroids = first_centroids(points, k, seed)
    if not centroids:
        return points.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    for _ in range(rounds):
        before = centroids
        sums = round_sums(points, centroids, dims)
        centroids = [[s // sums[c][0] for s in sums[c][1]] if c in sums else old for c, old in enumerate(centroids)]
        if centroids == before:  # every later round would give the same
            break
    return assign(points, centroids, dims), centroids


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256."""
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    place = F.col("cluster") + 1
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), place) if values else F.lit(None).cast(kind)
    return assigned.withColumns({
        "cluster_inertia": of([sums.get(c, 0) for c in range(len(centroids))], "long"),
        "inertia": F.lit(sum(sums.values())).cast("long"),
        "centroid_sha256": of(names, "string")})
