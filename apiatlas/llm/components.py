"""Connected components of an edge table, as alternating star contractions.

Large-star links every larger neighbour of a node to the node's smallest neighbour;
small-star does the same for the smaller ones. Repeated in turn until nothing changes,
every node hangs on its component's smallest node. Each round is one aggregation and one
join per star and is written to the shared folder; no row ever holds a node's neighbours,
so a node with many edges is only a key that the join may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apiatlas.session import write_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have v < u, as large-star leaves them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge other than a component's smallest.

    ``edges``: (u, v) of long ids; direction, repeats and loops don't matter; rows with a
    null are left out. A node that is missing from the result is its own component."""
    now = write_table(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        now = write_table(_small_star(_large_star(now)))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
