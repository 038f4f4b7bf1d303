from conftest import rows

from apiatlas.operators import urls as U

CAND_SCHEMA = "project string, path string, line int, library string, text string, ord long, verb string"


def _decompose(spark, texts, keep_invalid=False):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    d = U.decompose_urls(df, keep_invalid=keep_invalid)
    return {r["text"]: r for r in d.collect()}


def test_decompose_edge_rows(spark):
    r = _decompose(spark, [
        "https://h.com", "https://h.com/", "www.h.com/a/", "http://h.com?x=1",
        "http://h.com/a?x=&y=1&z=1=2", "http://h.com/a?x=1=", "http://h.com/a?x=1&x=2",
        "http://h.com/a?x=1#f#g", "http://h.com/a#f", "http://h.com/a?=b&a=b=",
        "wss://s.io:9/x", "http://h.com/?#", "http://h.com/a#",
    ])
    assert r["https://h.com"]["base_url"] == "https://h.com" and r["https://h.com"]["endpoint"] is None
    assert r["https://h.com/"]["endpoint"] is None
    assert r["www.h.com/a/"]["base_url"] == "http://www.h.com" and r["www.h.com/a/"]["endpoint"] == "a"
    q = r["http://h.com?x=1"]
    assert q["endpoint"] == "" and [tuple(e) for e in q["queries"]] == [("x", "1")]
    assert [tuple(e) for e in r["http://h.com/a?x=&y=1&z=1=2"]["queries"]] == [("y", "1")]
    assert [tuple(e) for e in r["http://h.com/a?x=1="]["queries"]] == [("x", "1")]
    assert [tuple(e) for e in r["http://h.com/a?x=1&x=2"]["queries"]] == [("x", "2")]
    f = r["http://h.com/a?x=1#f#g"]
    assert f["fragments"] == ["f", "g"] and [tuple(e) for e in f["queries"]] == [("x", "1")]
    assert r["http://h.com/a#f"]["fragments"] == ["f"]
    assert sorted(tuple(e) for e in r["http://h.com/a?=b&a=b="]["queries"]) == [("", "b"), ("a", "b")]
    assert r["wss://s.io:9/x"]["base_url"] == "wss://s.io:9"
    assert r["http://h.com/?#"]["endpoint"] is None  # remainder of '?'/'#' only
    assert r["http://h.com/a#"]["fragments"] == [""]


def test_decompose_rejects(spark):
    r = _decompose(spark, ["HTTP://h.com/a", "ftp://h.com", "h.com/a", "http://", "http:///a"], keep_invalid=True)
    assert all(not v["is_url"] for v in r.values())
    assert _decompose(spark, ["HTTP://h.com/a", "http://"]) == {}


def test_catalog_merge_rules(spark):
    data = [
        ("p", "f1", 1, "libA", "http://a", 1, None),        # base first seen without endpoint
        ("p", "f2", 1, "libB", "http://a/x?k=1#f1", 2, "GET"),
        ("p", "f3", 1, "libC", "http://a/x?k=2&j=3#f2", 3, "POST"),
        ("p", "f4", 1, "libD", "http://a", 4, None),         # no endpoint: ignored, library unchanged
        ("p", "f5", 1, "libE", "http://b/y", 5, None),
        ("q", "g1", 1, "libF", "https://c", 6, None),
    ]
    cand = spark.createDataFrame(data, CAND_SCHEMA)
    cat = U.flatten_catalog(U.build_url_catalog(cand))
    got = rows(cat, "project", "base_url", "library", "first_path", "endpoint", "query_string",
               "fragments", "http_methods")
    assert got == sorted([
        ("p", "http://a", "libC", "f1", "x", "j=3&k=1", "f1", "GET,POST"),
        ("p", "http://b", "libE", "f5", "y", None, None, None),
        ("q", "https://c", "libF", "g1", None, None, None, None),
    ], key=repr)


def test_query_pairs_first_value(spark):
    data = [("p", "f", 1, "l", "http://a/x?k=1", 2, None), ("p", "f", 1, "l", "http://a/x?k=0&m=1", 1, None)]
    got = rows(U.url_query_pairs(spark.createDataFrame(data, CAND_SCHEMA)))
    assert got == [("p", "http://a", "x", "k", "0"), ("p", "http://a", "x", "m", "1")]
