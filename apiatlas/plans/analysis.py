"""End-to-end analysis of a folder of projects, composed from the jobs.

``analyze_projects(spark, root)`` reads every project under ``root`` and
returns the catalog, JSON models, String variables, snippets, dependencies
and statistics as DataFrames; with ``out_dir`` it also writes the report, the
snippet logs and the model log. Every step is a Spark job of
``apiatlas.operators``; nothing is collected to the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiatlas.functions import encoding as enc
from apiatlas.operators import facts, jsonmodel, libraries, program, resolve, samples, stats
from apiatlas.operators import urls as U
from apiatlas.plans import dims
from apiatlas.session import write_table
from apiatlas.sources import readers, sinks

# a statement that sets a base URL, and a converter factory in it
BASE_URL_CALL = r'baseUrl\(\s*"([^"]*)"\s*\)'
BASE_URL_STATEMENT = r'[^;{}]*baseUrl\(\s*"[^"]*"\s*\)[^;{}]*'
CONVERTER = r"addConverterFactory\(\s*(\w+)"
GSON_LIBRARY = jsonmodel.GSON


def _order(column: str):
    """Order keys of one type, whichever extractor made them."""
    return F.struct(F.col(f"{column}.path").alias("path"), F.col(f"{column}.line").cast("int").alias("line"), F.col(f"{column}.pos").cast("int").alias("pos"))


def analyze_corpus(spark: SparkSession, corpus: DataFrame, build_files: DataFrame | None = None,
                   max_depth: int | None = None) -> dict[str, DataFrame]:
    """``corpus(project, path, content)`` (and optional build files) -> results."""
    # comments, literals and code are told apart once, for all extractors
    corpus = write_table(facts.tokenised(corpus))
    # literals feed both the URL and the JSON branch: extracted once, written once
    lits = write_table(facts.extract_literals(corpus))
    text = enc.unescape_java(F.col("literal"))
    order = F.struct("path", "line", "pos")
    # string literals: URL candidates first; the others are JSON candidates
    url_cands = lits.filter(F.col("kind") == "url").select(
        "project", "path", "line", F.lit("noLib.StringLiteralExpr").alias("library"), text.alias("text"),
        order.alias("ord"), F.lit(None).cast("string").alias("verb"))
    # annotated routes joined with the base URLs set on the builders of the same project
    routes = facts.extract_routes(corpus).withColumn("client", F.col("project")) \
        .withColumn("ord", F.struct("path", F.lit(0).alias("line"), F.lit(0).alias("pos")))
    builders = corpus.select("project", F.col("project").alias("client"), F.explode(
        F.regexp_extract_all("_code", F.lit(BASE_URL_STATEMENT), F.lit(0))).alias("text"))
    bases = builders.select("project", "client", F.regexp_extract("text", BASE_URL_CALL, 1).alias("url")).distinct()
    # a project's routes are not tied to one builder: they serialise with every converter that it sets
    factories = builders.select("project", F.explode(F.regexp_extract_all("text", F.lit(CONVERTER), F.lit(1))).alias("arg_scope"))
    converters = jsonmodel.converter_libraries(factories.select(
        "project", F.col("arg_scope").alias("client"), F.lit(0).alias("pos"), F.lit("addConverterFactory").alias("call"), "arg_scope")) \
        .select("project", "library").distinct()
    route_cands = U.join_base_urls(U.expand_routes(routes), bases).select(
        "project", "path", F.lit(0).alias("line"), "library", "text", "ord", "verb")
    # what stands in no single literal: builders, concatenations, constructors
    program_facts = program.Program(corpus)
    source = program.source_candidates(program_facts)
    texts = write_table(source["texts"].dropDuplicates(["project", "path", "line", "library", "text"]))
    candidates = url_cands.unionByName(route_cands).unionByName(source["urls"].withColumn("ord", _order("ord"))) \
        .unionByName(texts.select("project", "path", "line", "library", "text", _order("ord").alias("ord"), F.lit(None).cast("string").alias("verb")))
    catalog = U.build_url_catalog(candidates)

    json_cands = lits.filter(F.col("kind") == "text").select(
        "project", "path", F.lit("noLib.StringLiteralExpr").alias("library"), F.col("literal").alias("text"),
        order.alias("ord"))
    joined_cands = texts.select("project", "path", F.when(F.col("library") == "noLib.StringLiteralExpr", "noLib.BinaryExpr")
                                .otherwise(F.col("library")).alias("library"), "text", _order("ord").alias("ord"))
    text_models = jsonmodel.build_json_models(json_cands.unionByName(joined_cands))
    fields_tbl = facts.extract_fields(corpus)
    body_types = routes.select("project", F.explode("params").alias("p")) \
        .filter(F.col("p.ann") == "Body").select("project", F.regexp_replace("p.type", r"<.*$", "").alias("class")) \
        .distinct()
    class_models = jsonmodel.schema_from_fields(fields_tbl, body_types, max_depth=max_depth, enums=facts.extract_enums(corpus)) \
        .join(converters, "project", "left") \
        .select("project", F.col("class").alias("model_id"), F.col("skeleton").alias("canonical"),
                F.coalesce("library", F.lit(GSON_LIBRARY)).alias("library"))
    models = text_models.select("project", "model_id", "canonical", "library").unionByName(class_models)

    string_vars = facts.collect_string_vars(corpus)
    calls = program.typed_calls(program_facts, corpus, [r[3] for r in dims.CALL_RULES if r[3]])
    matched = libraries.match_call_rules(calls, dims.call_rule_dim(spark),
                                         facts.extract_imports(corpus, dims.library_dim(spark)))
    blocks = program.extract_blocks(program_facts.facts)
    sites = matched.select("project", "path", "line", "library", "kind", "name") \
        .withColumn("id", F.concat_ws(":", "project", "path", F.col("line").cast("string"), "name"))
    enclosing = resolve.enclosing_block(
        sites.select(F.concat_ws("/", "project", "path").alias("path"), "id", "line"),
        blocks.select(F.concat_ws("/", "project", "path").alias("path"), "kind", "name", "start_line", "end_line"),
        bucket_width=64, pos_col="line", id_cols=("id",))
    snippets = sites.join(enclosing.select("id", "block_kind", "block_name", "block_start", "block_end"), "id", "left") \
        .select("project", "path", "library", F.col("name").alias("call_type"), "line",
                F.coalesce("block_start", "line").alias("start_line"), F.coalesce("block_end", "line").alias("end_line"),
                "block_name")

    deps = libraries.extract_dependencies(build_files, dims.library_dim(spark)) if build_files is not None else \
        spark.createDataFrame([], "project string, library string, version string")
    fields = jsonmodel.explode_json_fields(text_models)
    projects = corpus.select("project").distinct()
    out = {
        "candidates": candidates, "catalog": catalog, "models": models, "string_vars": string_vars,
        "snippets": snippets, "dependencies": deps,
        "library_usage": stats.library_usage(deps, dims.library_dim(spark)),
        "project_counters": stats.project_counters(projects, deps, models),
        "models_per_library": stats.models_per_library(models, dims.model_library_dim(spark)),
        "field_usage": stats.field_usage(fields), "schemas": jsonmodel.corpus_schema(text_models),
        "project_summary": stats.project_summary(models, catalog),
    }
    filled = samples.fuzzy_fill_queries(
        catalog.select("project", "base_url", "endpoint", F.explode("queries").alias("q"))
        .select("project", "base_url", "endpoint", "q.key", "q.value"), string_vars)
    out["urls"] = U.rebuild_urls(catalog, filled)
    return out


def analyze_projects(spark: SparkSession, root: str, out_dir: str | None = None,
                     max_depth: int | None = None) -> dict[str, DataFrame]:
    """Every sub-folder of ``root`` is a project (``*.java`` sources, ``build.gradle``)."""
    corpus = readers.read_corpus(spark, root, "*.java")
    builds = readers.read_corpus(spark, root, "build.gradle").withColumn(
        "ord", F.struct("path"))
    res = analyze_corpus(spark, corpus, builds, max_depth)
    if out_dir:
        text_models = res["models"].filter(~F.col("library").isin(jsonmodel.GSON, jsonmodel.MOSHI))
        fields = samples.fuzzy_fill_json(jsonmodel.explode_json_fields(text_models), res["string_vars"])
        rendered = jsonmodel.json_skeleton(fields, both=True)
        report = sinks.build_report(urls=res["urls"], models=rendered, string_vars=res["string_vars"])
        sinks.write_report(report, os.path.join(out_dir, "report"))
        sinks.report_lines(report).write.mode("overwrite").partitionBy("project").parquet(
            os.path.join(out_dir, "report_lines"))
        sinks.write_snippets(res["snippets"], dims.library_dim(spark), os.path.join(out_dir, "snippets"))
        sinks.write_models(res["models"], os.path.join(out_dir, "models"))
    return res
