"""The pipeline: its stages in order, each on all that the one before kept."""
import hashlib

from pyspark.sql import functions as F

import corpus_pipeline as cp
from apiatlas.session import write_table

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    by_name = {}
    for name, stage in cp.STAGES:
        before, docs = docs, write_table(stage(spark, docs, SF))
        by_name[name] = (before, docs)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == list(cp.COLUMNS)
    assert [k for k, _ in cp.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "mix_sources", "bpe_encode_decode"]

    before, after = by_name["toxicity"]
    assert 0 < n - after.count() < n / 3 and after.exceptAll(before).count() == 0  # rejects go, the rest is unchanged
    before, after = by_name["line_dedup"]
    assert after.join(before, "doc_id", "left_anti").count() == 0
    assert after.filter(F.length("text") != F.col("n_chars")).count() == 0
    before, after = by_name["ngram_jaccard_join"]
    assert after.exceptAll(before).count() == 0 and after.count() == after.select("doc_id").distinct().count()
    before, after = by_name["mix_sources"]
    words = F.coalesce(F.sum(F.size(F.expr("regexp_extract_all(text, '[^ \\\\t-\\\\r]+', 0)"))), F.lit(0))
    total = before.agg(words).first()[0]  # documents are taken whole, so targets are met nearly
    assert abs(after.agg(words).first()[0] - total) <= 0.05 * total and after.select("text").exceptAll(before.select("text")).select("text").distinct().join(
        before.select("text").distinct(), "text", "left_anti").count() == 0
    before, after = by_name["bpe_encode_decode"]
    assert after.count() == before.count()
    r = after.first()
    assert r["ids_sha256"] == hashlib.sha256(bytes(r["ids"])).hexdigest() and r["n_tokens"] * 4 == len(r["ids"])


def test_stages_take_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x\ny\nz", "en", None, 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in cp.STAGES:
            assert stage(spark, docs, SF).count() <= len(rows) * 3
