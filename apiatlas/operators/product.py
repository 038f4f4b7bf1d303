"""Products of alternatives, kept as factors until their rows are written.

A product of lists is the list of its factors and a number of combinations. Rows are made by
unranking: the n-th combination's choice in each factor follows from n alone (the last factor
turns fastest). So one key's combinations are dealt to tasks by their numbers, and no row ever
holds more than the factors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiatlas.session import shuffle_partitions

#: Combinations that one row of numbers stands for.
CHUNK = 4096


def combinations(factors: Column) -> Column:
    """How many combinations the factors have; beyond 64 bits an error, as nobody could hold them."""
    return F.aggregate(factors, F.lit(1).cast("long"), lambda n, f: F.coalesce(
        F.try_multiply(n, F.size(f).cast("long")), F.raise_error(F.lit("more than 2^63 combinations of one key")).cast("long")))


def choices(df: DataFrame, factors: str, limit: int | None = None) -> DataFrame:
    """One row for each combination of ``factors`` ARRAY<ARRAY<...>>: the columns of ``df`` (``factors`` left
    out), ``nth`` from 0 on and ``choice``, one element of every factor. A factor without elements gives
    no rows. ``limit`` keeps each row's first combinations only."""
    others = [c for c in df.columns if c != factors]
    total = combinations(F.col(factors))
    counted = df.withColumn("_total", F.least(total, F.lit(limit).cast("long")) if limit else total).filter("_total > 0")
    chunked = counted.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_total") - 1) / CHUNK))))
    # a fixed number of partitions: the rows are few and small until their numbers are spread out
    dealt = chunked.repartition(shuffle_partitions(df.sparkSession), "_chunk", *others)
    numbered = dealt.withColumn("nth", F.explode(F.sequence(F.col("_chunk") * CHUNK, F.least("_total", (F.col("_chunk") + 1) * CHUNK) - 1)))
    kind = df.schema[factors].dataType.elementType.simpleString()
    start = F.struct(F.col("nth").alias("rest"), F.array().cast(kind).alias("out"))
    choice = F.aggregate(F.reverse(factors), start, lambda s, f: F.struct(
        F.floor(s["rest"] / F.size(f)).cast("long").alias("rest"),
        F.array_prepend(s["out"], F.get(f, (s["rest"] % F.size(f)).cast("int"))).alias("out")), lambda s: s["out"])
    return numbered.select(*others, "nth", choice.alias("choice"))


def merged_runs(steps: Column, sep: str = "") -> Column:
    """Factors of an ordered ARRAY<ARRAY<STRING>>: neighbours with one alternative each become one."""
    kind = "array<array<string>>"

    def add(out: Column, step: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        one = (F.size(out) > 0) & (F.size(last) == 1) & (F.size(step) == 1)
        both = F.array(F.array(F.concat(last[0], F.lit(sep), step[0])))
        return F.when(one, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), both)).otherwise(F.array_append(out, step))

    return F.aggregate(steps, F.array().cast(kind), add)
