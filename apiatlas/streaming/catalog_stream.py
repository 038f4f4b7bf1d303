"""The API catalog kept up to date from a stream of candidate strings.

The reference is batch only; this is the same job U1+U2 on Structured
Streaming. Each micro-batch is decomposed and pre-aggregated to catalog
partials, merged with the stored partials and written as a new version
(``foreachBatch``; the version path carries the batch id, so a replayed
batch overwrites its own output instead of merging twice).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from apiatlas.operators import urls as U

CANDIDATE_SCHEMA = ("project string, path string, line int, library string, text string, "
                    "ord long, verb string")


def _latest_version(spark: SparkSession, state_dir: str, before: int) -> str | None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return None
    versions = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            v = int(name[2:])
            if v < before:
                versions.append(v)
    return os.path.join(state_dir, f"v={max(versions)}") if versions else None


def merge_batch(state_dir: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        partials = U.catalog_partials(batch)
        prev = _latest_version(spark, state_dir, batch_id)
        if prev is not None:
            partials = U.merge_partials(spark.read.parquet(prev).unionByName(partials))
        partials.write.mode("overwrite").parquet(os.path.join(state_dir, f"v={batch_id}"))
    return run


def stream_url_catalog(spark: SparkSession, source_dir: str, state_dir: str, checkpoint_dir: str,
                       trigger_once: bool = True) -> StreamingQuery:
    """Start the stream: parquet candidate files arriving in ``source_dir``."""
    src = spark.readStream.schema(CANDIDATE_SCHEMA).parquet(source_dir)
    w = src.writeStream.foreachBatch(merge_batch(state_dir)).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start()


def current_catalog(spark: SparkSession, state_dir: str) -> DataFrame:
    """The catalog as of the newest completed version."""
    latest = _latest_version(spark, state_dir, 1 << 62)
    if latest is None:
        raise FileNotFoundError(f"no catalog state under {state_dir}")
    return U.finalize_catalog(spark.read.parquet(latest))
