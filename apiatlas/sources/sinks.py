"""Sinks S5, S7, S8: the per-project report, snippet logs, the model log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apiatlas.session import ensure_checkpoint_dir
from apiatlas.sources.readers import REPORT_SECTIONS

SECTION_ORDER = {s.rstrip(":"): i for i, s in enumerate(REPORT_SECTIONS)}


def build_report(urls: DataFrame | None = None, models: DataFrame | None = None,
                 string_vars: DataFrame | None = None) -> DataFrame:
    """Report entries ``(project, section, ord, raw, populated)``.

    * ENDPOINTS: ``rebuild_urls`` rows (raw URL, sample-filled URL);
    * JSON: ``(project, model_id, skeleton, populated)`` models;
    * STRING VARIABLES: ``{"name": [values]}`` per variable (raw only).
    ``ord`` orders entries inside a section deterministically.
    """
    parts = []
    if urls is not None:
        parts.append(urls.select("project", F.lit("ENDPOINTS").alias("section"),
                                 F.concat_ws("/", "base_url", "endpoint").alias("ord"),
                                 F.col("raw_url").alias("raw"), F.col("populated_url").alias("populated")))
    if models is not None:
        parts.append(models.select("project", F.lit("JSON").alias("section"), F.col("model_id").alias("ord"),
                                   F.col("skeleton").alias("raw"), F.col("populated")))
    if string_vars is not None:
        parts.append(string_vars.select(
            "project", F.lit("STRING VARIABLES").alias("section"), F.col("name").alias("ord"),
            F.to_json(F.create_map(F.col("name"), F.col("values"))).alias("raw"),
            F.lit(None).cast("string").alias("populated")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def number_within(df: DataFrame, group: list[str], order: list[str], num_partitions: int | None = None) -> DataFrame:
    """Add ``rn`` = 1, 2, ... inside each ``group`` following ``order``, without
    putting a whole group into one task.

    Rows are range-partitioned on (group, order), so a hot group spreads over
    many partitions; each partition numbers its rows locally, and a small
    table of per-(partition, group) counts gives every partition its offset.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # materialised once (reliable checkpoint), so both branches below see the same partition ids
    ranged = df.repartitionByRange(n, *group, *order).withColumn("_pid", F.spark_partition_id()) \
        .checkpoint(eager=True)
    local = ranged.withColumn("_local", F.row_number().over(
        Window.partitionBy("_pid", *group).orderBy(*order)))
    counts = ranged.groupBy("_pid", *group).agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(offsets.select("_pid", *group, "_off"), ["_pid", *group]) \
        .withColumn("rn", (F.col("_off") + F.col("_local")).cast("long")).drop("_pid", "_local", "_off")


def report_lines(report: DataFrame) -> DataFrame:
    """Report entries -> numbered text lines ``(project, line_no, value)``: per
    section its marker, then raw and populated lines alternating (entries
    ordered by ``ord``); a String variable is one line. Entry numbers come from ``number_within`` (no project
    is gathered into one task); section offsets from per-section counts."""
    sec = F.create_map(*[x for k, v in SECTION_ORDER.items() for x in (F.lit(k), F.lit(v))])
    entries = report.withColumn("sec_no", F.try_element_at(sec, F.col("section")))
    numbered = number_within(entries, ["project", "sec_no"], ["ord"])
    per_entry = F.when(F.col("section") == "STRING VARIABLES", 1).otherwise(2)
    sizes = entries.groupBy("project", "sec_no").agg((F.sum(per_entry) + 1).alias("_lines"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_lines").over(
        Window.partitionBy("project").orderBy("sec_no").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)) + 1)
    markers = starts.select("project", F.col("_start").cast("long").alias("line_no"),
                            F.concat(F.try_element_at(F.create_map(*[x for k, v in SECTION_ORDER.items()
                                                                     for x in (F.lit(v), F.lit(k))]),
                                                      F.col("sec_no")), F.lit(":")).alias("value"))
    body = numbered.join(starts.select("project", "sec_no", "_start"), ["project", "sec_no"]) \
        .select("project", "_start", "rn", per_entry.alias("_per"), F.explode(F.slice(F.array(
            F.struct(F.lit(1).alias("k"), F.col("raw").alias("value")),
            F.struct(F.lit(2).alias("k"), F.coalesce("populated", "raw").alias("value"))), F.lit(1), per_entry)).alias("e")) \
        .select("project", (F.col("_start") + (F.col("rn") - 1) * F.col("_per") + F.col("e.k")).cast("long").alias("line_no"),
                F.col("e.value").alias("value"))
    return markers.unionByName(body)


def write_report(report: DataFrame, out_dir: str) -> None:
    """Entries as parquet partitioned by project and section."""
    report.write.mode("overwrite").partitionBy("project", "section").parquet(out_dir)


def write_snippets(snippets: DataFrame, library_dim: DataFrame, out_dir: str) -> None:
    """One log per library; snippets of unknown libraries are dropped (semi-join)."""
    snippets.join(library_dim.select("library"), "library", "left_semi") \
        .write.mode("overwrite").partitionBy("library").json(out_dir)


def write_models(models: DataFrame, out_dir: str) -> None:
    """All JSON models of all projects as one JSON-lines log."""
    models.write.mode("overwrite").json(out_dir)
