"""Corpus pipeline: from raw documents to token ids.

Each stage calls one operator of ``apiatlas.llm`` on all rows that the stage before it
kept; its result is written as Parquet and read again as the next stage's documents. All
stages but the last return the columns of ``documents``.

Cases: rows with null text, id or source pass every stage (a null text holds no word, is never
drawn by the mix, and so ends there); empty texts likewise; a text of any length is one row;
repeated rows are documents of their own until the n-gram join keeps one of them; an empty table
stays empty; further columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiatlas.llm import bpe, jaccard_join, line_windows, mixing, toxicity
from apiatlas.llm.common import WORD, crc_mod
from apiatlas.llm.queries import VOCABULARY
from apiatlas.session import write_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of an Arrow batch: whole documents are long, and executors hold several batches at once.
BATCH = 2_000


def _short_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, str(min(BATCH, int(spark.conf.get(name)))) if int(spark.conf.get(name)) > 0 else str(BATCH))


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, with n_chars counted from the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go; the others stay as they are."""
    _short_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.toxicity_scores(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    return scored.filter("score < 0.5").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; a document goes only if that
    leaves no word of it."""
    cleaned = line_windows.drop_repeated_lines(docs)
    return _documents(cleaned.filter((F.col("n_removed") == 0) | F.rlike("text", F.lit(WORD))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word-shingle links at 0.75 stays."""
    _short_batches(spark)
    return jaccard_join.keep_one_each(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each draw of the mix: a document comes, whole, as often as the mix repeats it."""
    return _documents(mixing.mixed_documents(mixing.draw_mix(docs)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's token ids (little-endian unsigned 32-bit integers), their number, and
    digests of the ids and of the text they decode to."""
    _short_batches(spark)
    out = bpe.encode_decode(docs, VOCABULARY)
    return out.select("doc_id", "source", bpe.token_count(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"), "ids")


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("ngram_jaccard_join", drop_near_duplicates),
          ("mix_sources", mix_sources), ("bpe_encode_decode", encode)]

#: Fitted models and hashed draws are beyond SQL; the stages are tested by themselves.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir))
    return docs
