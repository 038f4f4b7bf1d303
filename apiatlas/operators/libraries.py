"""Library and dependency jobs: F5 keyword match, F8 files without snippets,
L1 dependency extraction, L2 available-version match, L3 call rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEGACY_HTTP = "org.apache.http.legacy"
ANDROID_CORE = "android.core"
UNKNOWN_VARIABLE_VALUE = "UNKNOWN_VARIABLE_VALUE"


def match_keywords(texts: DataFrame, keywords: list[tuple[str, str]], text_col: str = "content",
                   keys=("project", "path"), first_only: bool = False) -> DataFrame:
    """case-insensitive keyword containment.

    ``keywords`` are (library, keyword) pairs in dictionary order: a fixed list, so each text
    is tested against literals in one projection, without a join; only hits are
    aggregated. Output one row per (keys, library) with the matching keyword count, or with
    ``first_only`` the first library in dictionary order.
    """
    keys = list(keys)
    order = {lib: i for i, lib in enumerate(dict.fromkeys(lib for lib, _ in keywords))}
    listed = F.array(*[F.struct(F.lit(lib).alias("library"), F.lit(order[lib]).alias("lib_order"), F.lit(kw.lower()).alias("kw"))
                       for lib, kw in keywords])
    found = F.filter(listed, lambda s: F.contains(F.col("_lt"), s["kw"]))
    hits = texts.select(*keys, F.lower(F.col(text_col)).alias("_lt")).select(*keys, F.inline(found))
    per_lib = hits.groupBy(*keys, "library").agg(F.min("lib_order").alias("lib_order"),
                                                 F.count("*").alias("n_keywords"))
    if not first_only:
        return per_lib
    return per_lib.groupBy(*keys).agg(F.min_by("library", "lib_order").alias("library"))


def files_without_snippets(imports: DataFrame, snippets: DataFrame, keys=("project", "path")) -> DataFrame:
    """F8: files that use a known library but produced no snippet (left anti join)."""
    return imports.join(snippets.select(*keys).distinct(), list(keys), "left_anti")


def extract_dependencies(build_files: DataFrame, library_dim: DataFrame) -> DataFrame:
    """L1: build-file text -> (project, library, version).

    Import lines are removed and ``${...}`` becomes ``UNKNOWN_VARIABLE_VALUE``;
    quoted ``group:artifact:version`` coordinates of a known group with exactly
    three tokens give (group, version); the legacy HTTP id gives version "0";
    ``compileSdkVersion N`` gives (android.core, N). A library seen in several
    places keeps the last one (file ``ord``, then position in the file).
    """
    cleaned = F.regexp_replace(F.regexp_replace("content", r"(?m)^[ \t]*import\b[^\n]*", ""),
                               r"\$\{[^}]*\}", UNKNOWN_VARIABLE_VALUE)
    f = build_files.select("project", "ord", cleaned.alias("_c"))
    coords = f.select("project", "ord", F.posexplode(F.regexp_extract_all("_c", F.lit(r"""['"]([^'"\n]+)['"]"""), 1))
                      .alias("pos", "coord")) \
        .select("project", "ord", "pos", F.split("coord", ":").alias("t"))
    known = coords.join(library_dim.select("library"), F.col("t")[0] == F.col("library"), "inner")
    deps = known.select("project", "ord", "pos", "library",
                        F.when(F.size("t") == 3, F.col("t")[2])
                        .when(F.col("library").contains(LEGACY_HTTP), F.lit("0")).alias("version")) \
        .filter(F.col("version").isNotNull()) \
        .withColumn("library", F.when(F.col("library").contains(LEGACY_HTTP), F.lit(LEGACY_HTTP))
                    .otherwise(F.col("library")))
    sdk = f.select("project", "ord", F.posexplode(F.regexp_extract_all(
        "_c", F.lit(r"""compileSdkVersion[ \t(]+['"]?([A-Za-z0-9_.]+)"""), 1)).alias("pos", "version")) \
        .select("project", "ord", (F.col("pos") + F.lit(1 << 20)).alias("pos"),
                F.lit(ANDROID_CORE).alias("library"), "version")
    allv = deps.unionByName(sdk)
    return allv.groupBy("project", "library").agg(
        F.max_by("version", F.struct("ord", "pos")).alias("version"))


def match_available_version(project_libs: DataFrame, available: DataFrame, library_dim: DataFrame) -> DataFrame:
    """L2: pick the library folder for each (project, library, version).

    Exact ``library-version`` folder when present (equi-join), else the
    reverse-alphabetically first folder whose name contains the library. The
    fallback joins folders with the fixed library dimension (broadcast, 21
    rows) first, so it is one row per library before meeting the projects.
    """
    exact = available.select(F.col("folder").alias("exact_folder")).distinct()
    j = project_libs.join(exact, F.concat_ws("-", "library", "version") == F.col("exact_folder"), "left")
    available = available.select("folder").distinct()
    fallback = available.join(library_dim.select("library"), F.col("folder").contains(F.col("library")), "inner") \
        .groupBy("library").agg(F.max("folder").alias("fallback_folder"))
    return j.join(fallback, "library", "left").select(
        "project", "library", "version",
        F.coalesce("exact_folder", "fallback_folder").alias("folder"),
        F.col("exact_folder").isNotNull().alias("exact"))


def match_call_rules(call_sites: DataFrame, rules: DataFrame, imports: DataFrame | None = None,
                     keys=("project", "path")) -> DataFrame:
    """L3: call sites -> library by rule.

    Equi-join with the rule table on (kind, name), then the rule's residual test: the
    expression's ``result_type``, the ``scope_type`` or one of ``arg_types`` must equal the
    rule type, and ``args`` must reach ``min_args``. A row whose fact carries no such type
    (regex facts carry none) matches a typed rule only if its file (``keys``) imports the
    rule's library (``imports(*keys, library)``, job P6); without imports it
    doesn't. One row per (site, library).
    """
    cs, keys = call_sites, list(keys)
    for c, t in (("result_type", "string"), ("scope_type", "string"), ("arg_types", "array<string>")):
        if c not in cs.columns:
            cs = cs.withColumn(c, F.lit(None).cast(t))
    r = rules.withColumnRenamed("library", "rule_library").withColumnRenamed("type", "rule_type")
    j = cs.join(r, ["kind", "name"], "inner").withColumn("library", F.coalesce("rule_library", "rule_type"))
    if imports is None:
        j = j.withColumn("_imported", F.lit(False))
    else:
        known = imports.select(*keys, "library").distinct().withColumn("_imported", F.lit(True))
        j = j.join(known, [*keys, "library"], "left").withColumn("_imported", F.coalesce("_imported", F.lit(False)))
    m, own = F.col("match"), F.col("_imported")
    type_ok = (m.isNull()
               | ((m == "result") & F.coalesce(F.col("result_type") == F.col("rule_type"), own))
               | ((m == "scope") & F.coalesce(F.col("scope_type") == F.col("rule_type"), own))
               | ((m == "arg") & F.when(F.col("arg_types").isNull(), own)
                  .otherwise(F.array_contains(F.col("arg_types"), F.col("rule_type")))))
    args_ok = F.col("min_args").isNull() | (F.size(F.coalesce("args", F.array().cast("array<string>")))
                                             >= F.col("min_args"))
    return j.filter(type_ok & args_ok).select(*call_sites.columns, "library").distinct()
