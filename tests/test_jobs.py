"""Unit tests of the jobs on small inline fact tables (semantics from the survey)."""

import json

from conftest import rows

from apiatlas.operators import facts, jsonmodel, libraries, resolve, samples, stats
from apiatlas.operators import urls as U
from apiatlas.plans import dims


def test_match_keywords_overlapping_and_case(spark):
    texts = spark.createDataFrame([
        ("p", "a.java", "new AsyncHttpClient(); Glide.with(x); GlideApp.foo()"),
        ("p", "b.java", "nothing to see"),
        ("q", "c.java", "SSLSocketFactory f = ...; new okhttpclient()"),
    ], "project string, path string, content string")
    got = rows(libraries.match_keywords(texts, dims.keyword_pairs(dims.LIBRARY_KEYWORDS)), "path", "library", "n_keywords")
    # AsyncHttpClient also contains HttpClient (two libraries list it); Glide and GlideApp overlap
    assert ("a.java", "com.github.bumptech.glide", 2) in got
    assert ("a.java", "com.loopj.android", 1) in got and ("a.java", "com.koushikdutta.async", 1) in got
    assert ("a.java", "org.apache.httpcomponents", 1) in got and ("a.java", "android.core", 1) in got
    assert ("c.java", "javax.net.ssl.SSLSocket", 2) in got and ("c.java", "java.net.Socket", 2) in got
    assert ("c.java", "com.squareup.okhttp3", 1) in got
    assert not [r for r in got if r[0] == "b.java"]
    first = rows(libraries.match_keywords(texts, dims.keyword_pairs(dims.LIBRARY_KEYWORDS), first_only=True),
                 "path", "library")
    assert ("c.java", "com.squareup.okhttp3") in first


def test_string_vars_and_literals(spark):
    texts = spark.createDataFrame([
        ("p", "A.java", 'String url = "http://a.com/x";\nString k="v";  key = "w"'),
        ("p", "B.java", 'url = "http://b.com"; s = "esc \\" q"'),
    ], "project string, path string, content string")
    got = {r["name"]: r["values"] for r in facts.collect_string_vars(texts, pattern=facts.STRING_ASSIGNMENT).collect()}
    assert got["url"] == ["http://a.com/x", "http://b.com"]
    assert got["k"] == ["v"] and got["key"] == ["w"] and got["s"] == ['esc \\" q']
    lits = rows(facts.extract_literals(texts), "path", "line", "pos", "literal", "kind")
    assert ("A.java", 0, 0, "http://a.com/x", "url") in lits
    assert ("A.java", 1, 1, "w", "text") in lits


def test_keep_maximal_spans(spark):
    spans = spark.createDataFrame([("f", 0, 10), ("f", 2, 5), ("f", 5, 12), ("f", 0, 10), ("g", 1, 1)],
                                  "path string, start int, end int")
    assert rows(facts.keep_maximal_spans(spans)) == [("f", 0, 10), ("f", 5, 12), ("g", 1, 1)]


def test_enclosing_block_innermost(spark):
    blocks = spark.createDataFrame([
        ("F.java", "class", "F", 1, 100), ("F.java", "method", "a", 10, 20), ("F.java", "method", "b", 30, 90),
        ("F.java", "method", "inner", 40, 50), ("G.java", "class", "G", 1, 5)],
        "path string, kind string, name string, start_line int, end_line int")
    pos = spark.createDataFrame([("F.java", 1, 15), ("F.java", 2, 45), ("F.java", 3, 95), ("F.java", 4, 200),
                                 ("G.java", 5, 3)], "path string, id int, pos int")
    got = rows(resolve.enclosing_block(pos, blocks, bucket_width=16), "id", "block_name")
    assert got == [(1, "a"), (2, "inner"), (3, "F"), (5, "G")]


def test_product_fold_and_cap(spark):
    app = spark.createDataFrame([("p", "sb", 1, ["a"]), ("p", "sb", 2, ["b", "c"]), ("p", "sb", 3, ["d"]),
                                 ("p", "t", 1, ["x"])], "project string, builder string, pos int, alts array<string>")
    assert rows(resolve.fold_appends(app), "builder", "value") == [("sb", "abd"), ("sb", "acd"), ("t", "x")]
    capped = resolve.fold_appends(app, max_alternatives=1)
    assert rows(capped, "builder", "value") == [("sb", "abd"), ("t", "x")]


def test_expand_concat_drops_unresolved_and_quotes(spark):
    parts = spark.createDataFrame([
        ("p", "e1", 0, "literal", "http://", None, None), ("p", "e1", 1, "ref", None, "host", None),
        ("p", "e2", 0, "literal", "{\"a\":", None, None), ("p", "e2", 1, "ref", None, "missing", "int"),
        ("p", "e2", 2, "literal", "}", None, None), ("p", "e3", 0, "op", None, None, None)],
        "project string, expr_id string, pos int, part_kind string, literal string, ref string, declared_type string")
    resolved = spark.createDataFrame([("p", "host", ["a.com", "b.com"])], "project string, ref string, alternatives array<string>")
    assert rows(resolve.expand_concat(parts, resolved), "expr_id", "value") == [("e1", "http://a.com"), ("e1", "http://b.com")]
    q = rows(resolve.expand_concat(parts, resolved, quote_unknown=True), "expr_id", "value")
    assert ("e2", '{"a":"<INTEGER>"}') in q and not [r for r in q if r[0] == "e3"]


def test_resolve_field_visibility(spark):
    defs = spark.createDataFrame([
        ("p", "pk", "A.java", "A", None, "pub", "field", "init", "public", "d1"),
        ("p", "pk", "A.java", "A", None, "pro", "field", "init", "protected", "d2"),
        ("p", None, "N.java", "N", None, "pro", "field", "init", "protected", "d3"),
        ("p", "pk", "A.java", "A", None, "pri", "field", "init", "private", "d4")],
        "project string, package string, path string, class string, method string, name string, kind string, "
        "role string, visibility string, expr_id string")
    uses = spark.createDataFrame([
        ("p", "other", "Z.java", "m", "pub", "u1"), ("p", "pk", "B.java", "m", "pro", "u2"),
        ("p", "x", "N.java", "m", "pro", "u3"), ("p", "pk", "A.java", "m", "pri", "u4"),
        ("p", "pk", "B.java", "m", "pri", "u5"), ("p", "pk", "A.java", None, "pri", "u6")],
        "project string, package string, path string, method string, name string, expr_id string")
    got = rows(resolve.resolve_field(uses, defs), "use_id", "def_id")
    assert got == [("u1", "d1"), ("u2", "d2"), ("u3", "d3"), ("u4", "d4")]


def test_resolve_iterative_depth_and_cycles(spark):
    defs = spark.createDataFrame([
        ("p", "a", "name", None, "b"), ("p", "b", "name", None, "c"), ("p", "c", "literal", "X", None),
        ("p", "b", "literal", "Y", None), ("p", "c", "name", None, "a")],
        "project string, name string, value_kind string, value string, ref string")
    starts = spark.createDataFrame([("p", "a", "a")], "project string, start string, name string")
    got = rows(resolve.resolve_iterative(starts, defs, max_depth=5), "start", "value", "depth")
    assert got == [("a", "X", 2), ("a", "Y", 1)]
    assert rows(resolve.resolve_iterative(starts, defs, max_depth=1), "value") == [("Y",)]


def test_json_models_types_and_skeleton(spark):
    cands = spark.createDataFrame([
        ("p", "f", "l", '{"a":9.0,"b":12345678901,"c":[1,"<STRING>",{"d":true}],"e":null,"f":"<INTEGER>"}', 1),
        ("p", "f", "l", '{ "a" : 9.0, "b":12345678901, "c":[1,"<STRING>",{"d":true}], "e":null, "f":"<INTEGER>"}', 2),
        ("p", "f", "l", '[1,2]', 3), ("p", "f", "l", '{}', 4), ("p", "f", "l", '{"x":1', 5)],
        "project string, path string, library string, text string, ord long")
    models = jsonmodel.build_json_models(cands)
    assert models.count() == 1 and models.first()["first_ord"] == 1 and models.first()["n_occurrences"] == 2
    fields = jsonmodel.explode_json_fields(models)
    types = {r["path"]: r["jtype"] for r in fields.collect()}
    assert types["$.a"] == "NUMBER_INT" and types["$.b"] == "NUMBER_DOUBLE"
    assert types["$.c[1]"] == "STRING" and types["$.f"] == "NUMBER_INT" and types["$.e"] == "NULL"
    sk = json.loads(jsonmodel.json_skeleton(fields).first()["skeleton"])
    assert sk == {"a": "<NUMBER_INT>", "b": "<NUMBER_DOUBLE>", "c": ["<NUMBER_INT>", "<STRING>", {"d": "<BOOLEAN>"}],
                  "e": None, "f": "<NUMBER_INT>"}
    usage = rows(stats.field_usage(fields), "key", "n")
    assert ("d", 1) in usage and ("a", 1) in usage


def test_fold_json_puts_last_wins(spark):
    puts = spark.createDataFrame([("p", "o", 1, "k", "1", "number"), ("p", "o", 2, "k", "2", "number"),
                                  ("p", "o", 3, "s", 'a"b', "string"), ("p", "o", 4, "n", "null", "string"),
                                  ("p", "o", 5, "b", "TRUE", "boolean")],
                                 "project string, object string, pos int, key string, value string, value_type string")
    doc = jsonmodel.fold_json_puts(puts).first()["doc"]
    assert json.loads(doc) == {"b": True, "k": 2.0, "n": None, "s": 'a"b'}


def test_similarity_matches_textbook():
    from apiatlas.functions.similarity import jaro_winkler
    assert abs(jaro_winkler("abcdefgh", "abcdefgx") - 0.95) < 1e-9
    assert abs(jaro_winkler("MARTHA", "MARHTA") - 0.9611111) < 1e-6
    assert jaro_winkler("abc", "xyz") == 0.0


def test_fuzzy_fill_and_request_plan(spark):
    qp = spark.createDataFrame([("p", "http://a", "x", "userName", "<String>"), ("p", "http://a", "x", "n", "<Integer>"),
                                ("q", "http://b", "y", "token", "<STRING>")],
                               "project string, base_url string, endpoint string, key string, value string")
    sv = spark.createDataFrame([("p", "user_name", ["bob", "al\"ice"]), ("p", "password", ["pw"])],
                               "project string, name string, values array<string>")
    got = rows(samples.fuzzy_fill_queries(qp, sv), "project", "key", "value")
    assert got == [("p", "n", "0"), ("p", "userName", 'al\\"ice'), ("q", "token", "A")]
    eps = spark.createDataFrame([("p", "http://a/x"), ("p", "http://a/y")], "project string, url string")
    bodies = spark.createDataFrame([("p", "{}"), ("p", '{"a":1}'), ("p", '{"b":2}')], "project string, body string")
    plan = samples.request_plan(eps, bodies, dims.HTTP_METHODS)
    assert plan.count() == 2 * 5 + 2 * 4 * 3


def test_dependencies_and_versions(spark):
    bf = spark.createDataFrame([
        ("app", 1, "import foo.Bar\nandroid { compileSdkVersion 23 }\ndependencies {\n"
                   " implementation 'com.squareup.okhttp3:okhttp:3.12.0'\n compile \"com.android.volley:volley:${v}\"\n"
                   " useLibrary 'org.apache.http.legacy'\n implementation 'unknown.group:x:1'\n}"),
        ("app", 2, "dependencies { implementation 'com.squareup.okhttp3:okhttp:4.0.0' }")],
        "project string, ord int, content string")
    deps = rows(libraries.extract_dependencies(bf, dims.library_dim(spark)))
    assert deps == [("app", "android.core", "23"), ("app", "com.android.volley", "UNKNOWN_VARIABLE_VALUE"),
                    ("app", "com.squareup.okhttp3", "4.0.0"), ("app", "org.apache.http.legacy", "0")]
    avail = spark.createDataFrame([("android.core-23",), ("com.squareup.okhttp3-3.0",), ("com.squareup.okhttp3-3.9",)],
                                  "folder string")
    pl = spark.createDataFrame([("app", "android.core", "23"), ("app", "com.squareup.okhttp3", "4.0.0")],
                               "project string, library string, version string")
    got = rows(libraries.match_available_version(pl, avail, dims.library_dim(spark)), "library", "folder", "exact")
    assert got == [("android.core", "android.core-23", True), ("com.squareup.okhttp3", "com.squareup.okhttp3-3.9", False)]


def test_routes_and_bases(spark):
    routes = spark.createDataFrame([
        ("p", "c", "I.java", "Api", "users", "GET", "api/loadUsers",
         [("Query", "position", "int", 0), ("Query", "order", "String", 1)], 1),
        ("p", "c", "I.java", "Api", "user", "GET", "api/loadUser/{id}", [("Path", "id", "Integer", 0)], 2),
        ("p", "c", "I.java", "Api", "fixed", "GET", "api/x?a=1", [("Query", "b", "Object", 0),
                                                               ("Query", "c", "boolean", 1)], 3),
        ("p", "c", "I.java", "Api", "abs", "POST", "http://other.com/v", [], 4)],
        "project string, client string, path string, iface string, method string, verb string, template string, "
        "params array<struct<ann:string,arg:string,type:string,pos:int>>, ord long")
    ex = {r["method"]: r["route_url"] for r in U.expand_routes(routes).collect()}
    assert ex["users"] == "api/loadUsers?position=<Integer>&order=<String>"
    assert ex["user"] == "api/loadUser/<Integer>" and ex["fixed"] == "api/x?a=1&c=<Boolean>"
    bases = spark.createDataFrame([("p", "c", "http://retrofiturl.com/", None)],
                                  "project string, client string, url string, converter string")
    j = {r["method"]: r["text"] for r in U.join_base_urls(U.expand_routes(routes), bases).collect()}
    assert j["user"] == "http://retrofiturl.com/api/loadUser/<Integer>" and j["abs"] == "http://other.com/v"


def test_builder_fold_encoding(spark):
    steps = spark.createDataFrame([
        ("p", "F", "b1", 0, "scheme", ["http"], None), ("p", "F", "b1", 1, "host", ["okhttptestapi4.com"], None),
        ("p", "F", "b1", 2, "addPathSegment", ["api"], None), ("p", "F", "b1", 3, "addPathSegment", ["path1_/_1"], None),
        ("p", "F", "b1", 4, "username", ["x"], None), ("p", "F", "b1", 5, "addPathSegments", ["path2"], None),
        ("p", "F", "b2", 0, "parse", ["http://okhttptestapi5.com"], None),
        ("p", "F", "b2", 1, "addPathSegment", ["api"], None), ("p", "F", "b2", 2, "addPathSegment", ["pat#1"], None),
        ("p", "F", "b2", 3, "addQueryParameter", ["q n"], ["<STRING>", "v 1"]),
        ("p", "F", "b2", 4, "fragment", ["fragment/1"], None)],
        "project string, path string, builder string, pos int, step string, alts array<string>, alts2 array<string>")
    got = rows(U.fold_builder_steps(steps), "builder", "text")
    assert got == [("b1", "http://okhttptestapi4.com/api/path1_%2F_1/path2"),
                   ("b2", "http://okhttptestapi5.com/api/pat%231?q n=<STRING>#fragment/1"),  # placeholder: raw
                   ("b2", "http://okhttptestapi5.com/api/pat%231?q%20n=v%201#fragment/1")]


def test_resolve_param_scope_and_self_reference(spark):
    params = spark.createDataFrame([("p", "A.java", "A.pub", 0, "x", "public"), ("p", "A.java", "A.priv", 0, "y", "private")],
                                   "project string, path string, callee string, arg_pos int, name string, visibility string")
    args = spark.createDataFrame([
        ("p", "B.java", "A.pub", 0, "e1", "literal", "B.m", None), ("p", "A.java", "A.pub", 0, "e2", "name", "A.n", "v"),
        ("p", "B.java", "A.priv", 0, "e3", "literal", "B.m", None), ("p", "A.java", "A.priv", 0, "e4", "literal", "A.n", None),
        ("p", "A.java", "A.pub", 0, "e5", "call", "A.n", None), ("p", "A.java", "A.pub", 0, "e6", "name", "A.pub", "x")],
        "project string, path string, callee string, arg_pos int, expr_id string, arg_kind string, caller string, "
        "arg_ref string")
    got = rows(resolve.resolve_param(params, args), "callee", "expr_id")
    assert got == [("A.priv", "e4"), ("A.pub", "e1"), ("A.pub", "e2")]


def test_fold_json_puts_arrays_and_reassignment(spark):
    puts = spark.createDataFrame([
        ("p", "arr", 1, None, "a", "string", False), ("p", "arr", 2, None, "1", "number", False),
        ("p", "arr", 3, None, "true", "boolean", False),
        ("p", "o", 1, "k", "1", "number", False), ("p", "o", 2, "k", "2", "number", False),
        ("p", "o", 3, "x", "v", "string", True), ("p", "o", 4, "k", "3", "number", False)],
        "project string, object string, pos int, key string, value string, value_type string, is_new boolean")
    got = {(r["object"], r["doc_no"]): json.loads(r["doc"]) for r in jsonmodel.fold_json_puts(puts).collect()}
    assert got[("arr", "0")] == ["a", 1.0, True]
    assert got[("o", "0")] == {"k": 2.0} and got[("o", "3")] == {"x": "v", "k": 3.0}


def test_builder_initialiser_only_yields_nothing(spark):
    steps = spark.createDataFrame([
        ("p", "F", "b1", 0, "parse", ["http://a.com"], None, True),
        ("p", "F", "b2", 0, "parse", ["http://b.com"], None, True), ("p", "F", "b2", 1, "addPathSegment", ["x"], None, False)],
        "project string, path string, builder string, pos int, step string, alts array<string>, alts2 array<string>, "
        "is_init boolean")
    assert rows(U.fold_builder_steps(steps), "builder", "text") == [("b2", "http://b.com/x")]


def test_json_models_lenient(spark):
    cands = spark.createDataFrame([("p", "f", "l", "{a: 1, 'b': 'x'}", 1), ("p", "f", "l", '{"a":1,"b":"x"}', 2)],
                                  "project string, path string, library string, text string, ord long")
    assert jsonmodel.build_json_models(cands).count() == 1
    lenient = jsonmodel.build_json_models(cands, lenient=True).collect()
    assert len(lenient) == 1 and lenient[0]["n_occurrences"] == 2 and lenient[0]["first_ord"] == 1


def test_urls_from_candidates_and_assembly_forms(spark):
    exprs = spark.createDataFrame([("p", "e1", ["not a url", "https://a.com/x"]), ("p", "e2", ["ftp://x", "y"])],
                                  "project string, expr_id string, alternatives array<string>")
    got = rows(U.urls_from_candidates(exprs), "expr_id", "any_url", "n_urls")
    assert got == [("e1", True, 1), ("e2", False, 0)]
    parts = spark.createDataFrame([
        ("p", "one", 1, 0, ["http://a.com/x", "http://b.com"]),
        ("p", "two", 2, 0, ["http://c.com"]), ("p", "two", 2, 1, ["/p", "/q"]),
        ("p", "missing", 3, 0, ["http"]), ("p", "missing", 3, 2, ["/f"])],
        "project string, expr_id string, n_args int, arg_pos int, alternatives array<string>")
    got = rows(U.assemble_urls(parts), "expr_id", "text")
    assert got == [("one", "http://a.com/x"), ("one", "http://b.com"), ("two", "http://c.com/p"),
                   ("two", "http://c.com/q")]


def test_resolve_return_and_field_access(spark):
    calls = spark.createDataFrame([("p", "A.url", "c1"), ("p", "A.none", "c2")], "project string, callee string, expr_id string")
    rets = spark.createDataFrame([("p", "A.url", "r1"), ("p", "A.url", "r2"), ("q", "A.url", "r3")],
                                 "project string, callee string, expr_id string")
    assert rows(resolve.resolve_return(calls, rets), "call_id", "return_id") == [("c1", "r1"), ("c1", "r2")]
    acc = spark.createDataFrame([("p", "Api", "BASE", "a1"), ("p", "Other", "BASE", "a2")],
                                "project string, class string, name string, expr_id string")
    defs = spark.createDataFrame([("p", "Api", "BASE", "field", "init", "d1"), ("p", "Api", "BASE", "field", "assign", "d2")],
                                 "project string, class string, name string, kind string, role string, expr_id string")
    assert rows(resolve.resolve_field_access(acc, defs), "access_id", "def_id") == [("a1", "d1")]
