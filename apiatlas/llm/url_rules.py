"""URL filters: host-suffix and path-prefix expressions joined on short hashes.

Each URL expands into every host suffix (whole labels) times every path prefix that ends
at a slash; each rule is one such expression. The two sides meet in an equi-join on a
short prefix of the expression's SHA-256, then the full digest and the rule's whole path
are confirmed and the longest confirmed rule decides. Built-in functions only.

A rule ``host/path`` fits a URL when the URL's host is the rule's host or a subdomain of it
and the URL's path starts with the rule's path (a path need not end at a slash). Of
several fitting rules the one with most characters wins; among equally long ones the one
with the longer host. Rules that are given twice count once; ``block`` beats ``allow``.

Cases: a null URL or one without ``://`` has an empty host and path and fits no rule; an
empty host fits none; repeated rows each keep their own result; null ids stay null; an
empty table gives no rows; without rules every URL gets the default. Other columns pass
through; input columns named like a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apiatlas.session import write_table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Hex digits of the digest that the join uses.
SHORT = 8
RESULTS = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) rows from pairs such as ``("block", "net/")``."""
    return spark.createDataFrame([*rules], "verdict string, rule string")


def count_of(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """One row per rule: its host, path, folder (the path up to its last slash), the numbers
    of labels and slashes, and the digest of host and folder."""
    host = F.translate(F.regexp_extract("rule", "^[^/]*", 0), UPPER, UPPER.lower())
    path = F.regexp_extract("rule", "^[^/]*(.*)$", 1)
    return (rules.filter(F.col("verdict").isNotNull() & (F.length(host) > 0))
            .groupBy(host.alias("r_host"), path.alias("r_path"))
            .agg(F.min("rule").alias("r_rule"), F.max("verdict").alias("r_verdict"))
            .withColumn("r_folder", F.regexp_extract("r_path", "^(.*/)?", 0))
            .withColumns({"r_labels": count_of(F.col("r_host"), ".") + 1, "r_slashes": count_of(F.col("r_folder"), "/"),
                          "r_digest": F.sha2(F.concat("r_host", "r_folder"), 256)})
            .withColumn("r_short", F.substring("r_digest", 1, SHORT)))


def expressions(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """All host suffixes of up to ``labels`` labels times all folder prefixes of up to
    ``slashes`` slashes: longer ones are no rule's expression."""
    names = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))),
                           lambda k: F.array_join(F.slice(names, -k, k), "."))
    parts = F.split(path, "/", slashes + 1)
    prefixes = F.transform(F.sequence(F.lit(0), F.least(count_of(path, "/"), F.lit(slashes))),
                           lambda d: F.when(d == 0, F.lit("")).otherwise(
                               F.concat(F.array_join(F.slice(parts, 1, d), "/"), F.lit("/"))))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null: none fits) and ``verdict``.

    Each distinct (host, path) is judged once; the rules are written first, so that the
    planner knows their size when it chooses how to join."""
    rules = write_table(prepared_rules(rules))
    depth = rules.agg(F.max("r_labels").alias("labels"), F.max("r_slashes").alias("slashes")).first()
    if depth["labels"] is None:
        depth = {"labels": 1, "slashes": 0}
    host, path = host_and_path(F.col(url))
    wide = (pages.select(host.alias("host"), path.alias("path")).distinct()
            .withColumn("digest", F.explode(F.transform(
                expressions(F.col("host"), F.col("path"), depth["labels"], depth["slashes"]), lambda x: F.sha2(x, 256)))))
    met = wide.join(rules, (F.substring("digest", 1, SHORT) == F.col("r_short")) & (F.col("digest") == F.col("r_digest"))
                    & F.startswith(F.col("path"), F.col("r_path")))
    best = F.max_by(F.struct("r_rule", "r_verdict"), F.struct(F.length("r_rule"), F.length("r_host")))
    judged = met.groupBy("host", "path").agg(best.alias("best")).select(
        "host", "path", F.col("best.r_rule").alias("rule"), F.col("best.r_verdict").alias("verdict"))
    own = pages.withColumns({"host": host, "path": path}).drop("rule", "verdict")
    return own.join(judged, ["host", "path"], "left").select(
        *[c for c in pages.columns if c not in RESULTS], "host", "path", "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"))
