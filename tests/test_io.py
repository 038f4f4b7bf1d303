"""Sources, sinks, streaming and the driver contract."""

import json
import os
import tempfile

from conftest import rows
from pyspark.sql import functions as F

from apiatlas.operators import jsonmodel, samples
from apiatlas.operators import urls as U
from apiatlas.plans import dims
from apiatlas.sources import readers, sinks
from apiatlas.streaming import catalog_stream as CS


def _tree(base, files):
    for rel, text in files.items():
        p = os.path.join(base, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as f:
            f.write(text)


def test_read_corpus_lists_and_packages(spark):
    base = tempfile.mkdtemp(prefix="corpus-")
    _tree(base, {"app1/src/A.java": 'class A {\n  String u = "http://a.com/x";\n}\n',
                 "app1/build.gradle": "compileSdkVersion 23",
                 "app2/deep/er/B.java": "class B {}", "app2/notes.txt": "x", "apks/x.apk": "PK..",
                 "packages.csv": "package_name,version\norg.a.b,12\norg.c.d,3\n"})
    corpus = readers.read_corpus(spark, base)
    got = rows(corpus, "project", "path", "name")
    assert got == [("app1", "app1/src/A.java", "A.java"), ("app2", "app2/deep/er/B.java", "B.java")]
    assert corpus.filter("name = 'A.java'").first()["content"].count("\n") == 3  # whole file, one row
    assert rows(readers.read_corpus(spark, base, glob="build.gradle"), "project", "content") == [
        ("app1", "compileSdkVersion 23")]
    lst = readers.list_files(spark, base, ".apk")
    assert lst.columns == ["path", "length", "modificationTime"] and lst.count() == 1
    pk = readers.read_packages(spark, os.path.join(base, "packages.csv"))
    assert rows(pk) == [("org.a.b", 12), ("org.c.d", 3)]


def test_sinks_write(spark):
    out = tempfile.mkdtemp(prefix="sinks-")
    sn = spark.createDataFrame([("p", "A.java", "com.squareup.okhttp3", "new OkHttpClient()"),
                                ("p", "B.java", "noLib.Unknown", "x")],
                               "project string, path string, library string, call_code string")
    sinks.write_snippets(sn, dims.library_dim(spark), os.path.join(out, "snippets"))
    back = spark.read.json(os.path.join(out, "snippets"))
    assert rows(back, "path", "library") == [("A.java", "com.squareup.okhttp3")]
    models = spark.createDataFrame([("p", "m", '{"a":1}')], "project string, model_id string, canonical string")
    sinks.write_models(models, os.path.join(out, "models"))
    assert spark.read.json(os.path.join(out, "models")).count() == 1
    rep = sinks.build_report(models=models.select("project", "model_id", F.col("canonical").alias("skeleton"),
                                                  F.col("canonical").alias("populated")))
    sinks.write_report(rep, os.path.join(out, "report"))
    assert spark.read.parquet(os.path.join(out, "report")).count() == 1


def test_attach_http_method(spark):
    req = spark.createDataFrame([
        ("p", "r1", 0, "post", None), ("p", "r1", 1, "url", "b1"), ("p", "r1", 2, "patch", None),
        ("p", "r1", 3, "delete", None), ("p", "r2", 0, "url", "b2"), ("p", "r3", 0, "url", "b3"),
        ("p", "r3", 1, "put", None)], "project string, request string, pos int, call string, arg string")
    built = spark.createDataFrame([("p", "b1", "http://a/x"), ("p", "b2", "http://a/y"), ("p", "b3", "http://a/z")],
                                  "project string, builder string, text string")
    got = rows(U.attach_http_method(req, built), "builder", "verb")
    assert got == [("b1", "PATCH"), ("b2", None), ("b3", "PUT")]


def test_fuzzy_fill_json(spark):
    models = spark.createDataFrame([("p", "m1", '{"userName":"<STRING>","n":"<INTEGER>","ok":"<BOOLEAN>",'
                                                '"d":"<DOUBLE>","arr":["<STRING>"],"keep":"x"}')],
                                   "project string, model_id string, canonical string")
    fields = jsonmodel.explode_json_fields(models)
    sv = spark.createDataFrame([("p", "user_name", ["bob"]), ("p", "zzz", ["q"])],
                               "project string, name string, values array<string>")
    filled = samples.fuzzy_fill_json(fields, sv)
    doc = json.loads(jsonmodel.json_skeleton(filled, with_values=True).first()["skeleton"])
    assert doc == {"userName": "bob", "n": 0, "ok": True, "d": 0.0, "arr": ["<STRING>"], "keep": "x"}


def test_streaming_catalog_matches_batch(spark):
    base = tempfile.mkdtemp(prefix="stream-")
    schema = CS.CANDIDATE_SCHEMA
    b1 = [("p", "f1", 1, "libA", "http://a/x?k=1", 1, "GET"), ("p", "f2", 1, "libB", "http://a", 2, None)]
    b2 = [("p", "f3", 1, "libC", "http://a/x?k=2&j=3#f", 3, "POST"), ("q", "g", 1, "libD", "https://c/y", 4, None)]
    src = os.path.join(base, "source")
    spark.createDataFrame(b1, schema).write.parquet(os.path.join(src, "part1"))
    q = CS.stream_url_catalog(spark, os.path.join(src, "*"), os.path.join(base, "state"), os.path.join(base, "ck"))
    q.awaitTermination()
    spark.createDataFrame(b2, schema).write.parquet(os.path.join(src, "part2"))
    q = CS.stream_url_catalog(spark, os.path.join(src, "*"), os.path.join(base, "state"), os.path.join(base, "ck"))
    q.awaitTermination()
    streamed = U.flatten_catalog(CS.current_catalog(spark, os.path.join(base, "state")))
    batch = U.flatten_catalog(U.build_url_catalog(spark.createDataFrame(b1 + b2, schema)))
    assert rows(streamed) == rows(batch)


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "base_url" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())
