"""The reference's end-to-end assertions (FIXTURES.md §1), replayed from small
fact tables through the jobs that produce them."""

import json

from apiatlas.operators import jsonmodel, resolve
from apiatlas.operators import urls as U

CAND = "project string, path string, line int, library string, text string, ord long, verb string"


def _catalog(spark, cands):
    cat = U.build_url_catalog(spark.createDataFrame(cands, CAND)).collect()
    return {(r["base_url"], r["endpoint"]): r for r in cat}


def test_okhttp_builders_into_catalog(spark):
    steps = spark.createDataFrame([
        ("app", "A.java", "b4", 0, "scheme", ["http"], None), ("app", "A.java", "b4", 1, "host", ["okhttptestapi4.com"], None),
        ("app", "A.java", "b4", 2, "addPathSegment", ["api"], None),
        ("app", "A.java", "b4", 3, "addPathSegment", ["path1_/_1"], None),
        ("app", "A.java", "b4", 4, "addPathSegment", ["path2"], None),
        ("app", "A.java", "b2", 0, "parse", ["http://okhttptestapi2.com"], None),
        ("app", "A.java", "b2", 1, "addQueryParameter", ["queryname1"], ["v1"]),
        ("app", "A.java", "b2", 2, "addQueryParameter", ["queryname2"], ["v2"]),
        ("app", "A.java", "b2", 3, "addEncodedQueryParameter", ["queryname3"], ["v3"]),
        ("app", "A.java", "b1", 0, "parse", ["http://1.1.1.1:23"], None),
        ("app", "A.java", "b1", 1, "addPathSegment", ["api"], None),
        ("app", "A.java", "b1", 2, "fragment", ["fragment/1"], None)],
        "project string, path string, builder string, pos int, step string, alts array<string>, alts2 array<string>")
    built = U.fold_builder_steps(steps)
    req = spark.createDataFrame([("app", "r1", 0, "url", "b1"), ("app", "r1", 1, "post", None)],
                                "project string, request string, pos int, call string, arg string")
    verbs = {r["builder"]: r["verb"] for r in U.attach_http_method(req, built).collect()}
    cands = [("app", "A.java", 1, "OkHttp", r["text"], i, verbs.get(r["builder"]))
             for i, r in enumerate(built.orderBy("builder").collect())]
    cat = _catalog(spark, cands)
    assert ("http://okhttptestapi4.com", "api/path1_%2F_1/path2") in cat
    q = cat[("http://okhttptestapi2.com", "")]
    assert sorted(e["key"] for e in q["queries"]) == ["queryname1", "queryname2", "queryname3"]
    f = cat[("http://1.1.1.1:23", "api")]
    assert f["fragments"] == ["fragment/1"] and f["http_methods"] == ["POST"]


def test_url_constructor_with_port(spark):
    parts = spark.createDataFrame([("app", "e", 4, 0, ["http"]), ("app", "e", 4, 1, ["apiurl4.com"]), ("app", "e", 4, 2, ["80"]),
                                   ("app", "e", 4, 3, ["/some/path"])],
                                  "project string, expr_id string, n_args int, arg_pos int, alternatives array<string>")
    texts = [r["text"] for r in U.assemble_urls(parts).collect()]
    cat = _catalog(spark, [("app", "A.java", 1, "noLib.URL", t, 1, None) for t in texts])
    assert ("http://apiurl4.com:80", "some/path") in cat


def test_retrofit_routes_into_catalog(spark):
    routes = spark.createDataFrame([
        ("app", "c", "Api.java", "Api", "loadUser", "GET", "api/loadUser/{id}", [("Path", "id", "int", 0)], 1),
        ("app", "c", "Api.java", "Api", "loadUsers2", "GET", "api/loadUsers2?position=1234&order=rev", [], 2),
        ("app", "c", "Api.java", "Api", "createUser", "POST", "api/createUser", [("Body", "", "User", 0)], 3)],
        "project string, client string, path string, iface string, method string, verb string, template string, "
        "params array<struct<ann:string,arg:string,type:string,pos:int>>, ord long")
    bases = spark.createDataFrame([("app", "c", "http://retrofiturl.com/", None)],
                                  "project string, client string, url string, converter string")
    j = U.join_base_urls(U.expand_routes(routes), bases)
    cat = _catalog(spark, [("app", r["path"], 1, r["library"], r["text"], r["ord"], r["verb"]) for r in j.collect()])
    assert cat[("http://retrofiturl.com", "api/loadUser/<Integer>")]["http_methods"] == ["GET"]
    q = cat[("http://retrofiturl.com", "api/loadUsers2")]
    assert {e["key"]: e["value"] for e in q["queries"]} == {"position": "1234", "order": "rev"}
    assert cat[("http://retrofiturl.com", "api/createUser")]["http_methods"] == ["POST"]


def test_string_json_models(spark):
    texts = ['{\\"jstestkey8\\":8}', '{"jstestkey9":true}', '{"jstestkey10":10}', '{"jstestkey12":"<STRING>"}',
             '{"jstestkey11":"<INTEGER>"}']
    cands = spark.createDataFrame([("app", "A.java", "noLib.StringLiteralExpr", t, i) for i, t in enumerate(texts)],
                                  "project string, path string, library string, text string, ord long")
    models = jsonmodel.build_json_models(cands)
    docs = {r["canonical"] for r in models.collect()}
    assert '{"jstestkey8":8}' in docs and '{"jstestkey9":true}' in docs
    sk = {json.dumps(json.loads(r["skeleton"]), sort_keys=True)
          for r in jsonmodel.json_skeleton(jsonmodel.explode_json_fields(models)).collect()}
    assert '{"jstestkey11": "<NUMBER_INT>"}' in sk and '{"jstestkey12": "<STRING>"}' in sk


def test_string_concat_into_url(spark):
    parts = spark.createDataFrame([("app", "e", 0, "ref", None, "base"), ("app", "e", 1, "literal", "/path2", None)],
                                  "project string, expr_id string, pos int, part_kind string, literal string, ref string")
    resolved = spark.createDataFrame([("app", "base", ["https://someapi.com/some/endpoint"])],
                                     "project string, ref string, alternatives array<string>")
    vals = [r["value"] for r in resolve.expand_concat(parts, resolved).collect()]
    cat = _catalog(spark, [("app", "A.java", 1, "noLib.StringLiteralExpr", v, 1, None) for v in vals])
    assert ("https://someapi.com", "some/endpoint/path2") in cat


def test_org_json_puts(spark):
    puts = spark.createDataFrame([
        ("app", "o1", 1, "ojk7", "ojv7", "string"), ("app", "o1", 2, "ojk8", "null", "string"),
        ("app", "o1", 3, "ojk9", "9", "int"), ("app", "o1", 4, "ojk9_1", "91", "int"),
        ("app", "arr", 1, None, "true", "boolean"), ("app", "arr", 2, None, "20", "int"),
        ("app", "arr", 3, None, "ojv20", "string"), ("app", "o2", 1, "ojk20", "arr", "object")],
        "project string, object string, pos int, key string, value string, value_type string")
    docs = {r["object"]: r["doc"] for r in jsonmodel.nest_json_values(puts).collect()}
    assert json.loads(docs["o1"]) == {"ojk7": "ojv7", "ojk9_1": 91, "ojk8": None, "ojk9": 9}
    assert docs["o1"].count("91.0") == 0
    assert json.loads(docs["o2"]) == {"ojk20": [True, 20, "ojv20"]}


def test_gson_schema(spark):
    ann = "array<struct<name:string,key:string,value:string>>"
    cf = spark.createDataFrame([
        ("app", "UserGSON", "isVip", "boolean", [], False, False, [("SerializedName", None, "is_vip_GSON")]),
        ("app", "UserGSON", "name", "String", [], False, False, [("SerializedName", None, "nameGSON")]),
        ("app", "UserGSON", "id", "int", [], False, False, []),
        ("app", "UserGSON", "address", "Address", [], False, False, []),
        ("app", "UserGSON", "otherAddresses", "ArrayList", ["Address"], False, False, []),
        ("app", "Address", "name", "String", [], False, False, []),
        ("app", "Address", "number", "int", [], False, False, [])],
        f"project string, class string, field string, type string, type_args array<string>, is_enum boolean, "
        f"is_transient boolean, annotations {ann}")
    roots = spark.createDataFrame([("app", "UserGSON")], "project string, class string")
    sk = json.loads(jsonmodel.schema_from_fields(cf, roots).first()["skeleton"])
    assert sk == {"is_vip_GSON": "<BOOLEAN>", "otherAddresses": [{"name": "<STRING>"}, {"number": "<NUMBER_INT>"}],
                  "address": {"name": "<STRING>", "number": "<NUMBER_INT>"}, "nameGSON": "<STRING>",
                  "id": "<NUMBER_INT>"}
