"""Tests for code-fact extraction, call rules, class schemas, nesting, aliases, reports."""

import json

from conftest import rows

from apiatlas.operators import facts, jsonmodel, libraries, resolve
from apiatlas.plans import dims
from apiatlas.sources import readers, sinks

CODE = '''package a.b;
import okhttp3.OkHttpClient;
public interface Api {
    @GET("api/loadUsers")
    Call<List<User>> loadUsers(@Query("position") int position, @Query("order") String order);
    @POST("api/createUser") Call<User> createUser(@Body User user);
}
class Net {
    private transient String cache;
    @SerializedName("user_name") public String name;
    Request.Builder b = new Request.Builder();
    void run() { URLConnection c = url.openConnection(); HttpURLConnection h = (HttpURLConnection) url.openConnection(); }
}
'''


def test_extract_calls_routes_fields(spark):
    t = spark.createDataFrame([("p", "Api.java", CODE)], "project string, path string, content string")
    calls = rows(facts.extract_calls(t), "kind", "name", "scope")
    assert ("creation", "Builder", None) in calls and ("call", "openConnection", "url") in calls
    assert ("cast", "HttpURLConnection", "openConnection") in calls
    r = {x["method"]: x for x in facts.extract_routes(t).collect()}
    assert r["loadUsers"]["verb"] == "GET" and r["loadUsers"]["template"] == "api/loadUsers"
    assert [(p["ann"], p["arg"], p["type"]) for p in r["loadUsers"]["params"]] == [
        ("Query", "position", "int"), ("Query", "order", "String")]
    assert [(p["ann"], p["type"]) for p in r["createUser"]["params"]] == [("Body", "User")]
    f = {x["field"]: x for x in facts.extract_fields(t).collect()}
    assert f["cache"]["is_transient"] and f["name"]["annotations"][0]["value"] == "user_name"
    imports = spark.createDataFrame([("p", "Api.java", x) for x in ("java.net.URLConnection", "java.net.HttpURLConnection", "com.squareup.okhttp3")],
                                    "project string, path string, library string")
    lib = rows(libraries.match_call_rules(facts.extract_calls(t), dims.call_rule_dim(spark), imports), "name", "library")
    assert ("openConnection", "java.net.URLConnection") in lib and ("Builder", "com.squareup.okhttp3") in lib
    assert ("HttpURLConnection", "java.net.HttpURLConnection") in lib


def test_schema_from_fields(spark):
    ann = "array<struct<name:string,key:string,value:string>>"
    cf = spark.createDataFrame([
        ("p", "User", "is_vip", "boolean", [], False, False, []),
        ("p", "User", "name", "String", [], False, False, [("SerializedName", None, "nameGSON")]),
        ("p", "User", "id", "int", [], False, False, []),
        ("p", "User", "kind", "Kind", [], False, False, []),
        ("p", "User", "secret", "String", [], False, True, []),
        ("p", "User", "address", "Address", [], False, False, []),
        ("p", "User", "others", "List", ["Address"], False, False, []),
        ("p", "User", "tags", "Map", ["String", "Integer"], False, False, []),
        ("p", "Address", "number", "int", [], False, False, []),
        ("p", "Address", "name", "String", [], False, False, []),
        ("p", "Exp", "a", "String", [], False, False, [("Expose", None, None)]),
        ("p", "Exp", "b", "String", [], False, False, []),
        ("p", "Exp", "c", "String", [], False, False, [("Expose", "serialize", "false")])],
        f"project string, class string, field string, type string, type_args array<string>, is_enum boolean, "
        f"is_transient boolean, annotations {ann}")
    enums = spark.createDataFrame([("p", "Kind"), ("p", "Kind"), ("q", "Kind")], "project string, class string")
    roots = spark.createDataFrame([("p", "User"), ("p", "Exp")], "project string, class string")
    got = {r["class"]: json.loads(r["skeleton"]) for r in jsonmodel.schema_from_fields(cf, roots, enums=enums).collect()}
    assert got["User"] == {"is_vip": "<BOOLEAN>", "nameGSON": "<STRING>", "id": "<NUMBER_INT>", "kind": "<STRING>",
                           "address": {"name": "<STRING>", "number": "<NUMBER_INT>"},
                           "others": [{"name": "<STRING>"}, {"number": "<NUMBER_INT>"}],
                           "tags": [{"": "<NUMBER_INT>"}]}
    assert got["Exp"] == {"a": "<STRING>"}


def test_nest_json_values(spark):
    puts = spark.createDataFrame([
        ("p", "inner", 1, "k", "v", "string"), ("p", "outer", 1, "a", "1", "number"),
        ("p", "outer", 2, "child", "inner", "object"), ("p", "top", 1, "o", "outer", "object")],
        "project string, object string, pos int, key string, value string, value_type string")
    docs = {r["object"]: json.loads(r["doc"]) for r in jsonmodel.nest_json_values(puts).collect()}
    assert docs["top"] == {"o": {"a": 1.0, "child": {"k": "v"}}}


def test_alias_roots(spark):
    edges = spark.createDataFrame([("p", "A.main.sb", "B.add.x"), ("p", "B.add.x", "C.put.y"),
                                   ("p", "D.other.z", "C.put.y")], "project string, caller_var string, callee_var string")
    got = rows(resolve.alias_through_params(edges), "var", "root")
    assert ("C.put.y", "A.main.sb") in got and ("C.put.y", "D.other.z") in got and ("B.add.x", "A.main.sb") in got


def test_report_roundtrip(spark):
    urls = spark.createDataFrame([("p", "http://a", "x", "http://a/x?q=<String>", "http://a/x?q=A"),
                                  ("p", "http://a", "y", "http://a/y", "http://a/y")],
                                 "project string, base_url string, endpoint string, raw_url string, populated_url string")
    models = spark.createDataFrame([("p", "m1", '{"k":"<STRING>"}', '{"k":"A"}')],
                                   "project string, model_id string, skeleton string, populated string")
    report = sinks.build_report(urls=urls, models=models)
    lines = sinks.report_lines(report)
    text = [r["value"] for r in lines.orderBy("line_no").collect()]
    assert text == ["ENDPOINTS:", "http://a/x?q=<String>", "http://a/x?q=A", "http://a/y", "http://a/y",
                    "JSON:", '{"k":"<STRING>"}', '{"k":"A"}']
    back = rows(readers.read_report(lines), "section", "idx", "value")
    assert back == [("ENDPOINTS", 1, "http://a/x?q=A"), ("ENDPOINTS", 2, "http://a/y"), ("JSON", 1, '{"k":"A"}')]


def test_routes_last_verb_wins(spark):
    code = 'interface A {\n  @Headers("x: y")\n  @GET("a/b") @POST("c/d")\n  Call<X> m(@Path("id") int id);\n  @Override\n  void n();\n}'
    t = spark.createDataFrame([("p", "A.java", code)], "project string, path string, content string")
    r = facts.extract_routes(t).collect()
    assert [(x["method"], x["verb"], x["template"]) for x in r] == [("m", "POST", "c/d")]


def test_extract_imports_and_files_without_snippets(spark):
    texts = spark.createDataFrame([
        ("p", "A.java", "import okhttp3.OkHttpClient;\nimport java.util.List;\nimport static com.squareup.okhttp3.X.y;"),
        ("p", "B.java", "import java.net.HttpURLConnection;\nclass B {}"),
        ("p", "C.java", "class C {}")], "project string, path string, content string")
    imps = rows(facts.extract_imports(texts, dims.library_dim(spark)), "path", "import", "library")
    assert ("A.java", "com.squareup.okhttp3.X.y", "com.squareup.okhttp3") in imps
    assert ("B.java", "java.net.HttpURLConnection", "java.net.HttpURLConnection") in imps
    assert not [r for r in imps if r[1] in ("java.util.List", "okhttp3.OkHttpClient")]
    snippets = spark.createDataFrame([("p", "A.java")], "project string, path string")
    left = rows(libraries.files_without_snippets(facts.extract_imports(texts, dims.library_dim(spark)), snippets),
                "path", "library")
    assert left == [("B.java", "java.net.HttpURLConnection")]
