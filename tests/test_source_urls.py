"""The reference's URL assertions from Java text: builders, requests, concatenations, constructors."""
import pytest

from apiatlas.operators import program
from apiatlas.operators import urls as U

SOURCES = {
    "OkHttpTesting.java": '''package app.net;
public class OkHttpTesting {
    private HttpUrl fieldUrl = new HttpUrl.Builder().scheme("http").host("okhttptestapifield.com").addPathSegments("api/path").build();
    private HttpUrl.Builder fieldBuilder = new HttpUrl.Builder().scheme("https").host("urlbuilderfieldapi.com");
    static final String HOST4 = "okhttptestapi4.com";

    public void fields() {
        Request r = new Request.Builder().url(fieldUrl).delete().build();
        fieldBuilder.addPathSegment("api");
        fieldBuilder.addPathSegment("path1");
    }
    public void simple() {
        HttpUrl u = new HttpUrl.Builder().scheme("http").host("okhttptestapi.com").build();
        HttpUrl u2 = HttpUrl.parse("http://okhttptestapi2.com").newBuilder().addQueryParameter("queryname1", "v1")
            .addQueryParameter("queryname2", "v2").addEncodedQueryParameter("queryname3", "v3").build();
    }
    public void variable(boolean more) {
        HttpUrl.Builder b = HttpUrl.parse("http://okhttptestapi3.com").newBuilder();
        b.addQueryParameter("queryname1", "v1");
        if (more) { b.addQueryParameter("queryname2", "v2"); }
        queries(b, "encqn1");
        HttpUrl u = b.build();
    }
    private void queries(HttpUrl.Builder builder, String name) {
        builder.addEncodedQueryParameter(name, "x");
    }
    public void segments() {
        HttpUrl.Builder b = new HttpUrl.Builder();
        b.scheme("http").host(HOST4);
        b.addPathSegment("api").addPathSegment("path1_/_1").addPathSegment("path2");
        HttpUrl a = new HttpUrl.Builder().scheme("http").host("okhttptestapi5.com").addPathSegments("api/pat#1/path2").build();
        HttpUrl c = new HttpUrl.Builder().scheme("http").host("okhttptestapi6.com").addEncodedPathSegments("api/path1").addEncodedPathSegment("path2").build();
        HttpUrl d = HttpUrl.parse("http://" + host()).newBuilder().addPathSegment("api").addPathSegments("path1/path2").build();
    }
    private String host() { return "okhttptestapi7.com"; }
    public void verbs(RequestBody body) {
        HttpUrl one = new HttpUrl.Builder().scheme("http").host("1.1.1.1").port(23).addPathSegment("api").fragment("fragment/1").build();
        Request r1 = new Request.Builder().url(one).post(body).build();
        HttpUrl.Builder b2 = new HttpUrl.Builder().scheme("http").host("2.2.2.2").port(23);
        b2.addPathSegment("api");
        HttpUrl two = b2.build();
        Request.Builder rb = new Request.Builder();
        rb.url(two);
        rb.post(body);
        HttpUrl eight = HttpUrl.parse("http://8.8.8.8:23/api");
        call(new Request.Builder().get().url(eight).patch(body).build());
        HttpUrl nine = HttpUrl.parse("http://9.9.9.9:23/api");
        client.newCall(new Request.Builder().url(nine).header("a", "b").put(body).build()).execute();
        HttpUrl before = HttpUrl.parse("http://10.0.0.1/api");
        Request lost = new Request.Builder().delete().url(before).build();
    }
}
''',
    "Strings.java": '''package app.net;
public class Strings {
    public static final String BASE = "https://someapi.com/some/endpoint";
    private static String thirdBase;
    void init() { thirdBase = "http://thirdapi.ch/"; }
    void concat() {
        String base = BASE + "/path";
        String more = base + "/path2" + "/path3";
        String c = "https://someapi.com/".concat("concatPath1").concat("/concatPath2");
        String third = thirdBase + "pathname";
        String multi = "http://someotherapi.com/" +
            "path" + // a comment "in between"
            "/path2";
    }
    void builder() {
        StringBuilder sb = new StringBuilder("ignored");
        sb.append("http://fifthapi.com/").append(name("path1_1"));
        tail(sb);
        String done = sb.toString() + "?a=b";
    }
    private String name(String n) { return n; }
    private void tail(StringBuilder target) { target.append("/path2"); }
    void urls(int port) {
        URL a = new URL("https://apiurl.com/some/path");
        URL b = new URL(a2(), "some/path");
        URL c = new URL("http", "apiurl3.com", "/some/path");
        URL d = new URL("http", "apiurl4.com", 80, "/some/path");
    }
    String a2() { if (x) return "https://apiurl2.com/"; return null; }
    void json() { String s = "{\\"jstestkey" + 2 + "\\":\\"testvalue2\\"}"; }
}
''',
    "Other.java": '''package app.net;
class Other {
    void f(String id) {
        String s = Strings.BASE + "/static/path?user=" + id;
        String unknown = "https://unknown.com/" + call();
    }
}
''',
}


@pytest.fixture(scope="module")
def found(spark):
    corpus = spark.createDataFrame([("app", p, t) for p, t in SOURCES.items()], "project string, path string, content string")
    out = program.source_candidates(program.Program(corpus))
    texts = out["texts"].selectExpr("project", "path", "line", "library", "text", "ord", "CAST(NULL AS STRING) AS verb")
    cat = U.build_url_catalog(out["urls"].unionByName(texts)).collect()
    return {(r["base_url"], r["endpoint"]): r for r in cat}, {(r["library"], r["text"]) for r in out["texts"].collect()}


def test_okhttp_urls(found):
    cat, _ = found
    assert cat["http://okhttptestapifield.com", "api/path"]["http_methods"] == ["DELETE"]
    assert any(base == "http://okhttptestapi.com" for base, _ in cat)
    keys = lambda base: sorted(q["key"] for q in cat[base, ""]["queries"])
    assert keys("http://okhttptestapi2.com") == ["queryname1", "queryname2", "queryname3"]
    assert keys("http://okhttptestapi3.com") == ["encqn1", "queryname1", "queryname2"]
    for key in (("https://urlbuilderfieldapi.com", "api/path1"), ("http://okhttptestapi4.com", "api/path1_%2F_1/path2"),
                ("http://okhttptestapi5.com", "api/pat%231/path2"), ("http://okhttptestapi6.com", "api/path1/path2"), ("http://okhttptestapi7.com", "api/path1/path2")):
        assert key in cat, (key, sorted(cat))


def test_request_verbs(found):
    cat, _ = found
    assert cat["http://1.1.1.1:23", "api"]["http_methods"] == ["POST"] and cat["http://1.1.1.1:23", "api"]["fragments"] == ["fragment/1"]
    for host, verb in (("2.2.2.2:23", ["POST"]), ("8.8.8.8:23", ["PATCH"]), ("9.9.9.9:23", ["PUT"]), ("10.0.0.1", [])):
        assert cat[f"http://{host}", "api"]["http_methods"] == verb, host


def test_strings(found):
    cat, texts = found
    for base, endpoint in (("https://someapi.com", "some/endpoint/path"), ("https://someapi.com", "some/endpoint/path/path2/path3"), ("https://someapi.com", "concatPath1/concatPath2"),
                           ("http://thirdapi.ch", "pathname"), ("http://someotherapi.com", "path/path2"), ("http://fifthapi.com", "path1_1/path2"),
                           ("https://apiurl.com", "some/path"), ("https://apiurl2.com", "some/path"), ("http://apiurl3.com", "some/path"), ("http://apiurl4.com:80", "some/path"),
                           ("https://someapi.com", "some/endpoint/static/path")):
        assert (base, endpoint) in cat, (base, endpoint, sorted(cat))
    assert {q["key"]: q["value"] for q in cat["https://someapi.com", "some/endpoint/static/path"]["queries"]} == {"user": "<STRING>"}
    assert {q["key"] for q in cat["http://fifthapi.com", "path1_1/path2"]["queries"]} == {"a"}
    assert ("noLib.StringLiteralExpr", '{"jstestkey2":"testvalue2"}') in texts
    assert not any(base == "https://unknown.com" for base, _ in cat)


def test_blocks_end_where_their_braces_do(spark):
    text = "package p;\nclass A {\n  void f() {\n    if (x) {\n    }\n  }\n  class B {\n    void g() { new T() {\n      int h() { return 1; }\n    }; }\n  }\n}\nclass C {\n}\n"
    corpus = spark.createDataFrame([("app", "A.java", text), ("app", "n", None), ("app", "e", "")], "project string, path string, content string")
    got = {(r["kind"], r["name"]): (r["start_line"], r["end_line"], r["depth"]) for r in program.extract_blocks(program.source_facts(corpus)).collect()}
    assert got == {("class", "A"): (1, 11, 0), ("method", "f"): (2, 5, 1), ("class", "B"): (6, 10, 1), ("method", "g"): (7, 9, 2),
                   ("class", "T"): (7, 9, 3), ("method", "h"): (8, 8, 4), ("class", "C"): (12, 13, 0)}


CALLS = '''package p;
import com.android.volley.Response;
import java.net.*;
import org.apache.http.client.HttpClient;
class A {
  HttpClient client;
  void f(HttpClient own, com.loopj.android.http.AsyncHttpResponseHandler h) {
    client.execute(a); own.execute(b); other.execute(c);
    { Ion own2 = null; } 
    AsyncHttpClient c = new AsyncHttpClient();
    c.get("u", h);
    c.post("u", x);
    new StringRequest(1, "u", new Response.Listener<String>() { public void onResponse(String s) { } });
    URL url = new URL("http://a.com");
    HttpURLConnection con = (HttpURLConnection) url.openConnection();
    String no = (String) other.openConnection();
    for (HttpClient each : all) { each.execute(d); }
    if (x) { Local own3 = make(); own3.execute(e); }
  }
  void g(Other own) { own.execute(z); }
}
'''


def test_typed_rules(spark):
    from apiatlas.operators import libraries
    from apiatlas.plans import dims
    corpus = spark.createDataFrame([("app", "A.java", CALLS)], "project string, path string, content string")
    calls = program.typed_calls(program.Program(corpus), corpus, [r[3] for r in dims.CALL_RULES if r[3]])
    got = sorted((r["line"], r["kind"], r["name"], r["library"]) for r in libraries.match_call_rules(calls, dims.call_rule_dim(spark)).collect())
    assert got == [(7, "call", "execute", "org.apache.httpcomponents"), (7, "call", "execute", "org.apache.httpcomponents"),
                   (10, "call", "get", "com.loopj.android"), (12, "creation", "StringRequest", "com.android.volley"),
                   (14, "call", "openConnection", "java.net.URLConnection"), (14, "cast", "HttpURLConnection", "java.net.HttpURLConnection"),
                   (16, "call", "execute", "org.apache.httpcomponents")]
    types = {(r["name"], r["line"]): (r["scope_type"], r["arg_types"]) for r in calls.collect()}
    assert types["get", 10] == ("AsyncHttpClient", ["String", "com.loopj.android.http.AsyncHttpResponseHandler"])
    assert types["execute", 19][0] == "Other"
    assert "Response.Listener" in types["StringRequest", 12][1] and "com.android.volley.Response.Listener" in types["StringRequest", 12][1]


def test_string_declarations(spark):
    from apiatlas.operators import facts
    code = '''// String gone = "comment"
/* c = "z" */ @A(value = "w") class B { static final String A = "a", B = f("no", "x"), C = "c", D = "d" + x; b = "y";
 void f() { String s = "quo\\"te"; final String t
   = "two lines"; String[] l = {"n"}; Object o = "o"; java.lang.String u = "u"; call(v = "v"); } }'''
    df = spark.createDataFrame([("p", "A.java", code), ("p", "n", None)], "project string, path string, content string")
    assert {r["name"]: r["values"] for r in facts.collect_string_vars(df).collect()} == {
        "A": ["a"], "C": ["c"], "s": ['quo\\"te'], "t": ["two lines"], "u": ["u"]}


JSON = '''package p;
public class Json {
  private JSONObject field = new JSONObject();
  void puts(boolean b) throws JSONException {
    JSONObject o = new JSONObject();
    o.put("ojk1", "ojv1").put("ojk2", "ojv" + 2);
    o.put("ojk3", true);
    JSONObject n = new JSONObject();
    n.put("ojk7", "ojv7"); n.put("ojk8", null); n.put("ojk9", 9); n.put("ojk9_1", number());
    JSONArray a = new JSONArray();
    a.put(true).put(20).put("ojv20");
    JSONObject holder = new JSONObject();
    holder.put("ojk20", a);
    fill(holder, "ojk21");
    JSONObject seeded = new JSONObject("{\\"ojk10\\":\\"ojv10\\"}");
    seeded.put("ojk25", "ojv25");
    seeded = new JSONObject();
    seeded.put("ojk24", "ojv24");
    field.put("ojk30", 1.5);
  }
  private void fill(JSONObject target, String key) { target.put(key, "filled"); }
  int number() { return 91; }
}
'''


def test_json_objects(spark):
    import json
    corpus = spark.createDataFrame([("app", "Json.java", JSON)], "project string, path string, content string")
    texts = program.source_candidates(program.Program(corpus))["texts"].filter("library = 'org.json'").collect()
    key = lambda d: json.dumps(d, sort_keys=True)
    assert sorted({key(json.loads(r["text"])) for r in texts}) == sorted(key(d) for d in (
        {"ojk1": "ojv1", "ojk2": "ojv2", "ojk3": True}, {"ojk7": "ojv7", "ojk8": None, "ojk9": 9, "ojk9_1": 91}, {"ojk20": [True, 20, "ojv20"], "ojk21": "filled"},
        {"ojk10": "ojv10", "ojk25": "ojv25"}, {"ojk24": "ojv24"}, {"ojk30": 1.5}))
