"""Products of alternatives by number, and JSON documents from events."""
import itertools
import json

from apiatlas.operators import jsonmodel, product, resolve

EVENTS = "project string, object string, pos int, kind string, key string, alts array<struct<value:string,value_type:string>>"


def test_choices_in_order(spark):
    factors = [["a", "b"], ["x"], ["1", "2", "3"]]
    df = spark.createDataFrame([("k", factors), ("none", [["a"], []]), ("empty", [])], "name string, f array<array<string>>")
    rows = sorted((r["name"], r["nth"], r["choice"]) for r in product.choices(df, "f").collect())
    assert rows == [("empty", 0, [])] + [("k", i, list(c)) for i, c in enumerate(itertools.product(*factors))]
    assert [r["nth"] for r in product.choices(df, "f", 2).filter("name = 'k'").orderBy("nth").collect()] == [0, 1]


def test_a_million_combinations_of_one_key_spread(spark):
    app = spark.createDataFrame([("p", "sb", i, [str(d) for d in range(10)]) for i in range(6)], "project string, builder string, pos int, alts array<string>")
    out = resolve.fold_appends(app)
    sizes = [len(p) for p in out.rdd.glom().map(lambda rows: [1] * len(rows)).collect()]
    assert sum(sizes) == 10 ** 6 and max(sizes) < 10 ** 6 // 2
    assert out.selectExpr("count(DISTINCT value) AS n", "min(value) AS lo", "max(value) AS hi").first() == (10 ** 6, "000000", "999999")


def test_seeds_puts_and_new_documents(spark):
    rows = [("p", "o", 1, "seed", None, [('{"a":1,"b":{"c":[1,2]}}', "string"), ("no json", "string"), ('{\\"a\\":2}', "string")]),
            ("p", "o", 2, "put", "k", [("x", "string"), ("7", "int")]), ("p", "o", 3, "put", "a", [("first", "string")]),
            ("p", "o", 4, "put", "a", [("null", "string")]), ("p", "o", 5, "new", None, []), ("p", "o", 6, "put", "z", [("true", "boolean")]),
            ("p", "o", 7, "put", "unknown", []),
            ("p", "arr", 1, "seed", None, [("[1, \"s\"]", "string")]), ("p", "arr", 2, "put", None, [("9", "int"), ("t", "string")]),
            ("p", "plain", 3, "put", "q", [('say "hi"', "string")]), ("p", "bare", 1, "new", None, [])]
    out = jsonmodel.fold_json_events(spark.createDataFrame(rows, EVENTS)).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["object"], r["doc_no"], r["nth"])):
        got.setdefault((r["object"], r["doc_no"]), []).append(json.loads(r["doc"]))
    key = lambda d: json.dumps(d, sort_keys=True)
    assert sorted(got["o", 0], key=key) == sorted([{"a": None, "b": {"c": [1, 2]}, "k": "x"}, {"a": None, "b": {"c": [1, 2]}, "k": 7}, {"a": None, "k": "x"}, {"a": None, "k": 7}], key=key)
    assert got["o", 1] == [{"z": True}] and got["arr", 0] == [[1, "s", 9], [1, "s", "t"]] and got["plain", 0] == [{"q": 'say "hi"'}] and got["bare", 0] == [{}]
    assert len(got) == 5
