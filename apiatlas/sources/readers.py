"""Sources S1-S4, S6: corpus folders, file listings, the package list, reports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGES_SCHEMA = "package_name string, version long"
# Section markers of a report, in report order.
REPORT_SECTIONS = ["ENDPOINTS:", "JSON:", "STRING VARIABLES:", "JSON DETAILS:", "URL DETAILS:", "SNIPPETS:"]


def _relative(path_col, root: str):
    # the root may be named with its scheme, in fewer slashes than the files'
    root = re.sub(r"^[A-Za-z][\w+.-]*:(//[^/]*)?", "", root.rstrip("/"))
    return F.regexp_replace(path_col, "^.*?" + re.escape(root) + "/", "")


def read_corpus(spark: SparkSession, root: str, glob: str = "*.java") -> DataFrame:
    """Every sub-folder of ``root`` is a project; all files matching
    ``glob`` beneath it are read whole. Output ``(project, path, name, content)``.

    One row per file (``wholetext``); Spark splits the listing across tasks.
    ``glob="build.gradle"`` gives the build files (S2).
    """
    # text() has its own wholetext flag (default False) that overrides options
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
    rel = _relative(F.col("_metadata.file_path"), root)
    return df.select(F.substring_index(rel, "/", 1).alias("project"), rel.alias("path"),
                     F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))


def list_files(spark: SparkSession, root: str, suffix: str = ".apk") -> DataFrame:
    """S3: inventory of files by suffix; the binary content column is pruned,
    so files are listed, not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True) \
        .option("pathGlobFilter", "*" + suffix).load(root)
    return df.select("path", "length", "modificationTime")


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """The package list CSV (header ``package_name,version``)."""
    return spark.read.csv(path, header=True, schema=PACKAGES_SCHEMA)


def read_report(report_lines: DataFrame) -> DataFrame:
    """Report lines ``(project, line_no, value)`` -> populated lines of the
    ENDPOINTS and JSON sections.

    The section of a line is the last marker at or before it: the few marker
    lines of a project (at most six) meet its lines in an equi-join on
    ``project`` and a partial ``max_by`` keeps the nearest one, so no project
    is gathered into one task. Inside a section raw and populated lines
    alternate; the populated one is every second line.
    Output ``(project, section, idx, value)``.
    """
    markers = report_lines.filter(F.col("value").isin(REPORT_SECTIONS)).select(
        "project", F.col("line_no").alias("marker_line"), F.col("value").alias("section"))
    lines = report_lines.filter(~F.col("value").isin(REPORT_SECTIONS))
    j = lines.join(markers, "project").filter(F.col("marker_line") < F.col("line_no"))
    nearest = j.groupBy("project", "line_no").agg(
        F.max_by(F.struct("section", "marker_line"), "marker_line").alias("m"), F.first("value").alias("value"))
    sec = nearest.select("project", "line_no", "value", F.col("m.section").alias("section"),
                         (F.col("line_no") - F.col("m.marker_line")).alias("idx"))
    return sec.filter(F.col("section").isin("ENDPOINTS:", "JSON:") & (F.col("idx") % 2 == 0)) \
        .select("project", F.regexp_replace("section", ":$", "").alias("section"),
                (F.col("idx") / 2).cast("long").alias("idx"), "value")
