"""Sample generation G1-G4: fill placeholders, fuzzy-fill from String variables,
and the request plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiatlas.functions import encoding as enc
from apiatlas.functions.similarity import jaro_winkler_udf
from apiatlas.operators.jsonmodel import json_string

STRING_PLACEHOLDERS = ["<String>", "<STRING>"]


def fill_placeholders(df: DataFrame, cols: list[str]) -> DataFrame:
    """G1: placeholders -> sample values (String A, Double/Float 0.0, Integer 0, Boolean true)."""
    for c in cols:
        df = df.withColumn(c, enc.fill_placeholders(F.col(c)))
    return df


#: Buckets a project's variables are dealt to, so that one project's pairs meet in many tasks.
NAME_BUCKETS = 16


def _similarity_bound(a: Column, b: Column) -> Column:
    """A number that the Jaro-Winkler similarity of two names never exceeds: the characters of
    one that occur in the other bound the matches, and the prefix bonus needs an equal first
    character."""
    held = lambda x, y: F.size(F.filter(F.split(x, ""), lambda c: F.contains(y, c)))
    la, lb = F.length(a), F.length(b)
    m = F.least(held(a, b), held(b, a), la, lb)
    jaro = F.when(m > 0, (m / la + m / lb + 1) / 3).otherwise(F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).when(F.left(a, F.lit(1)) == F.left(b, F.lit(1)), jaro + 0.4 * (1 - jaro)).otherwise(jaro)


def most_similar_names(keys: DataFrame, string_vars: DataFrame) -> DataFrame:
    """Top-1 String variable per (project, key) by Jaro-Winkler, ties -> smallest name.

    Distinct keys meet distinct variable names of the same project through an equi-join on
    (project, bucket): variables are dealt to buckets, keys go to all of them, so a large
    project is no single task. An upper bound computed in the JVM comes first: each key's most
    promising name is scored, then only names whose bound reaches that score. The top-1
    is a partial ``min_by`` aggregate. Output ``(project, key, var_name, score, var_value)``
    with the smallest value of the chosen variable.
    """
    k = keys.select("project", "key").distinct() \
        .withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(NAME_BUCKETS - 1))))
    v = string_vars.select("project", F.col("name").alias("var_name"),
                           F.try_element_at(F.sort_array("values"), F.lit(1)).alias("var_value"),
                           F.pmod(F.hash("name"), F.lit(NAME_BUCKETS)).alias("_bucket"))
    pairs = k.join(v, ["project", "_bucket"]).withColumn("_bound", _similarity_bound(F.col("key"), F.col("var_name")))
    first = pairs.groupBy("project", "key").agg(F.max_by("var_name", F.struct("_bound", "var_name")).alias("_first")) \
        .withColumn("_least", jaro_winkler_udf("key", "_first")).drop("_first")
    near = pairs.join(first, ["project", "key"]).filter(F.col("_bound") >= F.col("_least") - 1e-9) \
        .withColumn("score", jaro_winkler_udf("key", "var_name"))
    best = near.groupBy("project", "key").agg(
        F.min_by(F.struct("var_name", "score", "var_value"), F.struct((-F.col("score")).alias("s"), "var_name"))
        .alias("b"))
    return best.select("project", "key", "b.var_name", "b.score", "b.var_value")


def _unquoted_json(col: Column) -> Column:
    s = json_string(col)
    return s.substr(F.lit(2), F.length(s) - 2)


def fuzzy_fill_queries(query_pairs: DataFrame, string_vars: DataFrame) -> DataFrame:
    """A String-placeholder query value takes the value of the project's most
    similar String variable (JSON-escaped, without quotes); other values -> G1.
    A project without String variables keeps the placeholder (then G1)."""
    need = query_pairs.filter(F.col("value").isin(STRING_PLACEHOLDERS))
    best = most_similar_names(need, string_vars)
    j = query_pairs.join(best.select("project", "key", "var_value"), ["project", "key"], "left")
    filled = F.when(F.col("value").isin(STRING_PLACEHOLDERS) & F.col("var_value").isNotNull(),
                    _unquoted_json(F.col("var_value"))).otherwise(enc.fill_placeholders(F.col("value")))
    return j.withColumn("value", filled).drop("var_value")


def fuzzy_fill_json(fields: DataFrame, string_vars: DataFrame) -> DataFrame:
    """Unknown leaves with a key get sample values: STRING -> most similar
    String variable, BOOLEAN -> true, NUMBER_INT -> 0, NUMBER_DOUBLE -> 0.0;
    array elements without a key stay unknown."""
    unknown = F.col("value").isNull() & ~F.col("jtype").isin("OBJECT", "ARRAY", "NULL") & F.col("key").isNotNull()
    need = fields.filter(unknown & (F.col("jtype") == "STRING"))
    best = most_similar_names(need, string_vars)
    j = fields.join(best.select("project", "key", "var_value"), ["project", "key"], "left")
    val = (F.when(~unknown, F.col("value"))
           .when(F.col("jtype") == "STRING", F.col("var_value"))
           .when(F.col("jtype") == "BOOLEAN", F.lit("true"))
           .when(F.col("jtype") == "NUMBER_INT", F.lit("0"))
           .when(F.col("jtype") == "NUMBER_DOUBLE", F.lit("0.0")))
    return j.withColumn("value", val).drop("var_value")


def request_plan(endpoints: DataFrame, bodies: DataFrame, methods: list[str]) -> DataFrame:
    """Endpoints x methods; every non-GET method also x every JSON body of
    the project. Rows = e*m + e*(m-1)*j per project. Methods are a literal
    array (explode, no join); bodies meet endpoints on ``project``."""
    e = endpoints.select("project", "url")
    plain = e.select("project", "url", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"),
                     F.lit(None).cast("string").alias("body"))
    non_get = [m for m in methods if m != "GET"]
    with_body = e.join(bodies.select("project", "body"), "project") \
        .select("project", "url", F.explode(F.array(*[F.lit(m) for m in non_get])).alias("method"), "body")
    return plain.unionByName(with_body)
