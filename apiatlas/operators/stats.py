"""Statistics A1-A5. All are partial/final hash aggregates; sorts are full
descending counts with the name as second key (the reference leaves ties in
hash order)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def library_usage(project_libraries: DataFrame, library_dim: DataFrame) -> DataFrame:
    """A1: projects per library, zero for unused libraries, descending."""
    n = project_libraries.groupBy("library").agg(F.countDistinct("project").alias("n_projects"))
    return library_dim.select("library").join(n, "library", "left") \
        .select("library", F.coalesce("n_projects", F.lit(0)).cast("long").alias("n_projects")) \
        .orderBy(F.desc("n_projects"), "library")


def project_counters(projects: DataFrame, project_libraries: DataFrame, models: DataFrame) -> DataFrame:
    """A2: projects total / with >=1 library / with exactly 1 / with >=1 model (one row)."""
    libs = project_libraries.groupBy("project").agg(F.countDistinct("library").alias("n_libs"))
    mods = models.groupBy("project").agg(F.count("*").alias("n_models"))
    p = projects.select("project").distinct().join(libs, "project", "left").join(mods, "project", "left")
    return p.agg(F.count("*").alias("n_projects"),
                 F.count_if(F.col("n_libs") >= 1).alias("n_with_library"),
                 F.count_if(F.col("n_libs") == 1).alias("n_with_one_library"),
                 F.count_if(F.col("n_models") >= 1).alias("n_with_models"))


def models_per_library(models: DataFrame, model_library_dim: DataFrame) -> DataFrame:
    """A3: models per extraction library; the fixed five are listed even at zero."""
    n = models.groupBy("library").agg(F.count("*").alias("n_models"))
    return model_library_dim.select("library").join(n, "library", "full") \
        .select("library", F.coalesce("n_models", F.lit(0)).cast("long").alias("n_models")) \
        .orderBy(F.desc("n_models"), "library")


def field_usage(fields: DataFrame) -> DataFrame:
    """A4: occurrences of each object key at any depth (through objects and arrays)."""
    return fields.filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n")) \
        .orderBy(F.desc("n"), "key")


def project_summary(models: DataFrame, catalog: DataFrame) -> DataFrame:
    """A5: number of JSON models and of base URLs per project."""
    m = models.groupBy("project").agg(F.count("*").alias("n_models"))
    b = catalog.groupBy("project").agg(F.countDistinct("base_url").alias("n_base_urls"))
    return m.join(b, "project", "full").select(
        "project", F.coalesce("n_models", F.lit(0)).cast("long").alias("n_models"),
        F.coalesce("n_base_urls", F.lit(0)).cast("long").alias("n_base_urls"))
