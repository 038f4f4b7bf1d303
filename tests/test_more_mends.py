"""Names by similarity, re-assigned documents, serializer libraries."""
import random

from apiatlas.functions.similarity import jaro_winkler
from apiatlas.operators import jsonmodel, samples
from conftest import rows


def test_most_similar_names_equal_all_pairs(spark):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdeXY_") for _ in range(rnd.randint(1, 9)))
    keys, names = sorted({word() for _ in range(60)}), sorted({word() for _ in range(80)})
    k = spark.createDataFrame([("p", x) for x in keys] + [("q", "a")], "project string, key string")
    v = spark.createDataFrame([("p", x, [x + "2", x + "1"]) for x in names], "project string, name string, values array<string>")
    got = {r["key"]: (r["var_name"], r["var_value"]) for r in samples.most_similar_names(k, v).collect()}
    want = {x: min(names, key=lambda n: (-jaro_winkler(x, n), n)) for x in keys}
    assert got == {x: (n, n + "1") for x, n in want.items()}


def test_reassigned_documents(spark):
    puts = spark.createDataFrame(
        [("p", "o", i, f"k{i % 3}", str(i), "int", i % 5 == 2) for i in range(40)] + [("p", "x", 1, "a", "1", "int", False)],
        "project string, object string, pos int, key string, value string, value_type string, is_new boolean")
    got = {(r["object"], r["doc_no"]): r["doc"] for r in jsonmodel.fold_json_puts(puts).collect()}
    want = {}
    for i in range(40):
        start = max((j for j in range(i + 1) if j % 5 == 2), default=0)
        want.setdefault(str(start), {})[f"k{i % 3}"] = i
    assert got.pop(("x", "0")) == '{"a":1}'
    assert got == {("o", d): "{" + ",".join(f'"{k}":{v}' for k, v in sorted(doc.items())) + "}" for d, doc in want.items()}


def test_converters_and_serializers(spark):
    calls = spark.createDataFrame(
        [("p", "c", 1, "addConverterFactory", "GsonConverterFactory"), ("p", "c", 2, "addConverterFactory", "MoshiConverterFactory"),
         ("p", "c", 3, "addConverterFactory", "Other"), ("p", "d", 1, "baseUrl", "GsonConverterFactory")],
        "project string, client string, pos int, call string, arg_scope string")
    assert rows(jsonmodel.converter_libraries(calls)) == [("p", "c", jsonmodel.MOSHI)]
    fields = spark.createDataFrame([("p", "A", "x", "int", [], False, False, [])],
                                   "project string, class string, field string, type string, type_args array<string>, is_enum boolean, "
                                   "is_transient boolean, annotations array<struct<name:string,key:string,value:string>>")
    uses = spark.createDataFrame([("p", "A", "GsonBuilder"), ("p", "A", "Moshi"), ("p", "A", "Moshi"), ("p", "A", "Parcel")],
                                 "project string, class string, scope_type string")
    got = rows(jsonmodel.serializer_models(uses, fields), "library", "skeleton")
    assert got == [(jsonmodel.GSON, '{"x":"<NUMBER_INT>"}'), (jsonmodel.MOSHI, '{"x":"<NUMBER_INT>"}')]
