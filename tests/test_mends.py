"""Cases in which earlier versions gave wrong, cut or failing results."""
import json

from pyspark.sql import functions as F

from apiatlas.operators import jsonmodel, libraries, resolve
from apiatlas.operators import urls as U
from apiatlas.plans import dims
from apiatlas.sources import sinks
from conftest import rows

DEF = "project string, name string, value_kind string, value string, ref string"
PUT = "project string, object string, pos int, key string, value string, value_type string"


def test_long_chains_resolve(spark):
    defs = spark.createDataFrame([("p", f"v{i}", "name", None, f"v{i - 1}") for i in range(1, 21)] + [("p", "v0", "literal", "X", None)], DEF)
    starts = spark.createDataFrame([("p", "v20", "v20")], "project string, start string, name string")
    assert rows(resolve.resolve_iterative(starts, defs), "value", "depth") == [("X", 20)]


def test_long_alias_chains_and_cycles(spark):
    edges = spark.createDataFrame([("p", f"v{i}", f"v{i + 1}") for i in range(20)] + [("p", "b", "a"), ("p", "a", "b"), ("p", "b", "c")],
                                  "project string, caller_var string, callee_var string")
    got = {r["var"]: (r["root"], r["depth"]) for r in resolve.alias_through_params(edges).collect()}
    assert got["v20"] == ("v0", 20) and got["c"] == ("a", 2) and got["a"] == ("a", 0) and got["b"] == ("a", 1)


def test_hot_name(spark):
    defs = spark.createDataFrame([("p", f"n{i}", "name", None, "hub") for i in range(500)] + [("p", "hub", "literal", "Y", None)], DEF)
    starts = defs.filter("value_kind = 'name'").select("project", F.col("name").alias("start"), "name")
    assert resolve.resolve_iterative(starts, defs).filter("value = 'Y' AND depth = 1").count() == 500


def test_deep_nesting(spark):
    puts = spark.createDataFrame([("p", f"o{i}", 1, "c", f"o{i + 1}", "object") for i in range(21)] + [("p", "o21", 1, "x", "1", "int")]
                                 + [("p", "l1", 1, "a", "l2", "object"), ("p", "l2", 1, "a", "l1", "object"), ("p", "two", 1, "a", "o21", "object"),
                                    ("p", "two", 2, "b", "o20", "object")], PUT)
    got = {r["object"]: r["doc"] for r in jsonmodel.nest_json_values(puts).collect()}
    assert len(got) == 23 and got["o0"] == '{"c":' * 21 + '{"x":1}' + "}" * 21
    assert got["two"] == '{"a":{"x":1},"b":{"c":{"x":1}}}'


def test_deep_documents(spark):
    text = '{"a":' * 70 + "1" + "}" * 70
    models = spark.createDataFrame([("p", "m", text)], "project string, model_id string, canonical string")
    nodes = jsonmodel.explode_json_fields(models)
    assert nodes.count() == 71
    assert jsonmodel.json_skeleton(nodes).first()["skeleton"] == text.replace("1", '"<NUMBER_INT>"')


def test_nodes_with_dots_in_keys(spark):
    text = '{"a":{"b.c":{"x":1}},"a.b":{"c":{"y":2}},"q\\"":[{"":3}]}'
    models = spark.createDataFrame([("p", "m", text)], "project string, model_id string, canonical string")
    got = json.loads(jsonmodel.json_skeleton(jsonmodel.explode_json_fields(models), with_values=True).first()["skeleton"])
    assert got == json.loads(text)


def test_json_string_keeps_line_separators(spark):
    for text in ("a\u0085b", "a b", "a\nb", '"', ""):
        df = spark.createDataFrame([(text,)], "t string")
        assert json.loads(df.select(jsonmodel.json_string(F.col("t")).alias("j")).first()["j"]) == text


def field(project, cls, name, kind):
    return (project, cls, name, kind, [], False, False, [])


FIELDS = ("project string, class string, field string, type string, type_args array<string>, is_enum boolean, is_transient boolean, "
          "annotations array<struct<name:string,key:string,value:string>>")


def test_enums_of_other_projects(spark):
    cf = spark.createDataFrame([field("p1", "A", "st", "Status"), field("p1", "Status", "n", "int")], FIELDS)
    enums = spark.createDataFrame([("p2", "Status"), ("p3", "Status")], "project string, class string")
    roots = spark.createDataFrame([("p1", "A")], "project string, class string")
    assert jsonmodel.schema_from_fields(cf, roots, enums=enums).first()["skeleton"] == '{"st":{"n":"<NUMBER_INT>"}}'


def test_classes_deeper_than_fifteen_and_cycles(spark):
    cf = spark.createDataFrame([field("p", f"C{i}", "f", f"C{i + 1}") for i in range(18)] + [field("p", "C18", "x", "int")]
                               + [field("p", "N", "left", "N"), field("p", "N", "right", "N"), field("p", "N", "v", "int")], FIELDS)
    roots = spark.createDataFrame([("p", "C0"), ("p", "N")], "project string, class string")
    got = {r["class"]: r["skeleton"] for r in jsonmodel.schema_from_fields(cf, roots).collect()}
    assert got["C0"] == '{"f":' * 18 + '{"x":"<NUMBER_INT>"}' + "}" * 18
    assert got["N"] == '{"left":{},"right":{},"v":"<NUMBER_INT>"}'


def test_projects_stay_apart(spark):
    parts = spark.createDataFrame([("p1", "e", 0, "literal", "a", None), ("p1", "e", 1, "literal", "b", None), ("p2", "e", 0, "literal", "c", None)],
                                  "project string, expr_id string, pos int, part_kind string, literal string, ref string")
    none = spark.createDataFrame([], "project string, ref string, alternatives array<string>")
    assert rows(resolve.expand_concat(parts, none)) == [("p1", "e", "ab"), ("p2", "e", "c")]
    args = spark.createDataFrame([("p1", "e", 1, 0, ["http://a"]), ("p2", "e", 1, 0, ["http://b"])],
                                 "project string, expr_id string, n_args int, arg_pos int, alternatives array<string>")
    assert rows(U.assemble_urls(args)) == [("p1", "e", "http://a"), ("p2", "e", "http://b")]


def test_verb_before_url(spark):
    req = spark.createDataFrame([("p", "r", 0, "post", None), ("p", "r", 1, "url", "b")],
                                "project string, request string, pos int, call string, arg string")
    built = spark.createDataFrame([("p", "b", "http://a/x")], "project string, builder string, text string")
    assert rows(U.attach_http_method(req, built), "text", "verb") == [("http://a/x", None)]


def test_expression_without_alternatives(spark):
    df = spark.createDataFrame([("p", "e", [])], "project string, expr_id string, alternatives array<string>")
    assert rows(U.urls_from_candidates(df), "any_url", "n_urls") == [(False, 0)]


def test_untyped_calls_need_an_import(spark):
    sites = spark.createDataFrame([("p", "A", "call", "get", ["x", "y"]), ("p", "B", "call", "execute", [])],
                                  "project string, path string, kind string, name string, args array<string>")
    rules = dims.call_rule_dim(spark)
    assert libraries.match_call_rules(sites, rules).count() == 0
    imports = spark.createDataFrame([("p", "A", "com.loopj.android"), ("p", "A", "android.core")], "project string, path string, library string")
    assert rows(libraries.match_call_rules(sites, rules, imports), "path", "library") == [("A", "com.loopj.android")]


def test_string_variables_are_one_line(spark):
    sv = spark.createDataFrame([("p", "a", ["1"]), ("p", "b", ["2", "3"])], "project string, name string, values array<string>")
    lines = sinks.report_lines(sinks.build_report(string_vars=sv)).orderBy("line_no").collect()
    assert [r["value"] for r in lines] == ["STRING VARIABLES:", '{"a":["1"]}', '{"b":["2","3"]}']
    assert [r["line_no"] for r in lines] == [1, 2, 3]


def test_hot_base_in_the_catalog(spark):
    cand = spark.range(4000).selectExpr("'p' AS project", "concat('f', id) AS path", "1 AS line", "'l' AS library",
                                        "concat(if(id % 10 = 0, 'http://b.com/', 'http://hot.com/'), id, '?k=', id) AS text", "id AS ord")
    cat = U.build_url_catalog(cand)
    assert cat.count() == 4000
    assert cat.filter("base_url = 'http://hot.com' AND first_path = 'f1' AND library = 'l'").count() == 3600
