"""Facts of a Java source: comments, literals, nested calls, types by their braces."""
from apiatlas.operators import facts
from conftest import rows

CODE = '''package p; // "http://comment/x" String no = "1";
/* "http://block/x"
   void old() { gone(); } */
public class A extends Base {
  private static final String TAG = "A";
  private final Map<String, List<String>> names = new HashMap<>();
  @SerializedName("user_name") protected transient String name;
  int[] numbers = {1, 2}, more;
  Kind kind;
  char q = '"'; String u = "http://h/x";
  String run(String arg) {
    String tmp = client.newCall(req.build("a,b", f(1, 2)), "x").execute();
    if (tmp == null) { return name; }
    return name;
  }
  static class B { boolean flag; class C { Double d; } long after; }
  enum Kind { ONE, TWO; int code; }
  String last;
}
interface I1 { @GET("a/{id}") Call<X> one(@Path("id") int id); }
interface I2 {
  @POST("b") Call<X> two(@QueryMap Map<String, String> m, @Query(value = "k", encoded = true) String k, @Body final User user);
}
'''


def source(spark):
    return spark.createDataFrame([("p", "A.java", CODE)], "project string, path string, content string")


def test_literals(spark):
    got = rows(facts.extract_literals(source(spark)), "line", "literal", "kind")
    assert ("url", "http://h/x") in [(k, x) for _, x, k in got] and (9, "http://h/x", "url") in got
    assert not [x for _, x, _ in got if "comment" in x or "block" in x or "String u" in x]


def test_calls(spark):
    got = {(r["kind"], r["name"]): (r["scope"], r["args"]) for r in facts.extract_calls(source(spark)).collect()}
    assert got["call", "newCall"] == ("client", ["req.build()", '"x"'])
    assert got["call", "build"] == ("req", ['"a,b"', "f()"])
    assert got["call", "f"] == (None, ["1", "2"]) and got["call", "execute"] == (None, [])
    assert got["creation", "HashMap"] == (None, []) and ("call", "gone") not in got


def test_arguments_over_lines_and_deep(spark):
    deep = "(" * 12 + "x, y" + ")" * 12
    code = "client.post(\n    url, // first, of two\n    f(a,\n      b));\nput(" + deep + ", z, g(\n" + deep + "));\nopen(k, l\nnone"
    df = spark.createDataFrame([("p", "A.java", code)], "project string, path string, content string")
    got = {r["name"]: (r["line"], r["args"]) for r in facts.extract_calls(df).collect()}
    assert got == {"post": (0, ["url", "f()"]), "f": (2, ["a", "b"]), "put": (4, ["()", "z", "g()"]), "g": (4, ["()"]), "open": (6, ["k", "l"])}


def test_fields(spark):
    got = {(r["class"], r["field"]): r for r in facts.extract_fields(source(spark)).collect()}
    assert set(got) == {("A", "names"), ("A", "name"), ("A", "numbers"), ("A", "kind"), ("A", "q"), ("A", "last"),
                        ("B", "flag"), ("B", "after"), ("C", "d")} | ({("A", "u")} if ("A", "u") in got else set())
    assert got["A", "names"]["type_args"] == ["String", "List<String>"] and got["A", "kind"]["is_enum"] and not got["C", "d"]["is_enum"]
    assert got["A", "name"]["is_transient"] and got["A", "name"]["visibility"] == "protected"
    assert [tuple(a) for a in got["A", "name"]["annotations"]] == [("SerializedName", None, "user_name")]
    assert rows(facts.extract_enums(source(spark))) == [("p", "Kind")]


def test_routes(spark):
    got = {r["method"]: r for r in facts.extract_routes(source(spark)).collect()}
    assert (got["one"]["iface"], got["one"]["verb"], got["one"]["template"]) == ("I1", "GET", "a/{id}")
    assert (got["two"]["iface"], got["two"]["verb"], got["two"]["template"]) == ("I2", "POST", "b")
    assert [tuple(p) for p in got["two"]["params"]] == [("QueryMap", "", "Map<String, String>", 0), ("Query", "k", "String", 1), ("Body", "", "User", 2)]


def test_long_texts_and_odd_quotes(spark):
    texts = ["x" * 300000, '"' + "y" * 200000 + '"', 'it\'s "open', "f(" * 2000, "/* open", None, ""]
    df = spark.createDataFrame([("p", str(i), t) for i, t in enumerate(texts)], "project string, path string, content string")
    assert rows(facts.extract_literals(df), "path")[0] == ("1",)
    assert facts.extract_calls(df).count() == 2000
    assert facts.extract_fields(df).count() == 0 and facts.extract_routes(df).count() == 0
