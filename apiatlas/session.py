"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: AQE re-plans joins/partition counts at runtime and
# splits skewed join partitions; the UI server stays off.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # recursive CTEs are bounded by depth; never by a row cap
    "spark.sql.cteRecursionRowLimit": "-1",
}


def get_spark(master: str | None = None, app: str = "apiatlas",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster that setting names shared storage and is used as is; without it a job
    that needs the folder stops. Only a local session (tests) gets a scratch folder.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="apiatlas-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return configured


def shuffle_partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize(df, keys: list[str] | None = None):
    """Write ``df`` once to the shared checkpoint folder (reliable checkpoint,
    lineage cut), hash-partitioned on ``keys`` when given. The written copy
    does not carry the partitioning into later plans."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if keys:
        df = df.repartition(shuffle_partitions(spark), *keys)
    return df.checkpoint(eager=True)


def write_table(df, partition_by: list[str] | None = None):
    """Write ``df`` once as parquet under the shared checkpoint folder and read
    it back (lineage cut, survives executor loss). ``partition_by`` lays the
    files out by those columns, so later filters on them prune partitions."""
    import uuid
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", uuid.uuid4().hex)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.parquet(path)


def write_large(df):
    """``write_table`` for tables that grow with the input: joins with them shuffle. Files of ids and
    texts are many times smaller than their rows in memory, so a table whose files are below the
    broadcast limit may still be too large for the driver."""
    return write_table(df).hint("merge")


class RoundTable:
    """A table that a job extends round by round, under the shared checkpoint folder: each
    round is written once, into a folder of its own, and ``all()`` reads what was written so
    far with the round's number in column ``name``."""

    def __init__(self, spark: SparkSession, name: str = "round"):
        import uuid
        self.spark, self.name, self.rounds = spark, name, 0
        self.path = os.path.join(ensure_checkpoint_dir(spark), "tables", uuid.uuid4().hex)
        self.schema = None

    def add(self, df: DataFrame) -> DataFrame:
        from pyspark.sql import functions as F
        folder = os.path.join(self.path, f"{self.name}={self.rounds}")
        df.write.parquet(folder)
        self.schema = self.schema or df.schema
        out = self.spark.read.schema(self.schema).parquet(folder).withColumn(self.name, F.lit(self.rounds))
        self.rounds += 1
        return out

    def all(self) -> DataFrame:
        from pyspark.sql import types as T
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(self.name, T.IntegerType())])).parquet(self.path)
