"""End-to-end on one small app, the way the reference's tests run (one app, many assertions)."""

import json
import os
import tempfile

from conftest import rows

from apiatlas.plans.analysis import analyze_projects

NET = '''package app.net;
import okhttp3.OkHttpClient;
import java.net.URLConnection;
public class Net {
    public static final String BASE = "https://someapi.com/some/endpoint";
    private String body = "{\\"jstestkey1\\":\\"testvalue1\\"}";

    public void open() throws Exception {
        URL url = new URL("http://apiurl3.com/some/path");
        URLConnection c = url.openConnection();
    }

    public void client() {
        OkHttpClient client = new OkHttpClient();
    }
}
'''
API = '''package app.net;
public interface Api {
    @GET("api/loadUsers")
    Call<List<User>> loadUsers(@Query("position") int position, @Query("order") String order);

    @POST("api/createUser")
    Call<User> createUser(@Body User user);
}
'''
SETUP = '''package app.net;
public class Setup {
    Retrofit r = new Retrofit.Builder().baseUrl("http://retrofiturl.com/").build();
}
'''
USER = '''package app.net;
public class User {
    @SerializedName("user_name") public String name;
    public int id;
    public Address address;
    private transient String cache;
}
'''
ADDRESS = '''package app.net;
public class Address {
    public String street;
    public int number;
}
'''
GRADLE = '''android {
    compileSdkVersion 23
}
dependencies {
    implementation 'com.squareup.okhttp3:okhttp:3.12.0'
    implementation "com.squareup.retrofit2:retrofit:${retrofitVersion}"
}
'''


def test_analyze_one_app(spark):
    root = tempfile.mkdtemp(prefix="apps-")
    files = {"app1/src/Net.java": NET, "app1/src/Api.java": API, "app1/src/Setup.java": SETUP,
             "app1/src/User.java": USER, "app1/src/Address.java": ADDRESS, "app1/build.gradle": GRADLE}
    for rel, text in files.items():
        os.makedirs(os.path.dirname(os.path.join(root, rel)), exist_ok=True)
        with open(os.path.join(root, rel), "w") as f:
            f.write(text)
    out = tempfile.mkdtemp(prefix="out-")
    res = analyze_projects(spark, root, out_dir=out)

    cat = {(r["base_url"], r["endpoint"]): r for r in res["catalog"].collect()}
    assert ("https://someapi.com", "some/endpoint") in cat and ("http://apiurl3.com", "some/path") in cat
    lu = cat[("http://retrofiturl.com", "api/loadUsers")]
    assert {e["key"]: e["value"] for e in lu["queries"]} == {"position": "<Integer>", "order": "<String>"}
    assert lu["http_methods"] == ["GET"] and lu["library"] == "Retrofit"
    assert cat[("http://retrofiturl.com", "api/createUser")]["http_methods"] == ["POST"]

    models = {r["canonical"]: r["library"] for r in res["models"].collect()}
    assert models['{"jstestkey1":"testvalue1"}'] == "noLib.StringLiteralExpr"
    user = [json.loads(m) for m, lib in models.items() if lib == "com.google.code.gson"]
    assert user == [{"user_name": "<STRING>", "id": "<NUMBER_INT>",
                     "address": {"street": "<STRING>", "number": "<NUMBER_INT>"}}]

    sv = {r["name"]: r["values"] for r in res["string_vars"].collect()}
    assert sv["BASE"] == ["https://someapi.com/some/endpoint"]

    snips = rows(res["snippets"], "library", "call_type", "block_name")
    assert ("java.net.URLConnection", "openConnection", "open") in snips

    assert rows(res["dependencies"], "library", "version") == [
        ("android.core", "23"), ("com.squareup.okhttp3", "3.12.0"), ("com.squareup.retrofit2", "UNKNOWN_VARIABLE_VALUE")]
    usage = dict(rows(res["library_usage"], "library", "n_projects"))
    assert usage["com.squareup.okhttp3"] == 1 and usage["com.github.bumptech.glide"] == 0
    assert rows(res["project_counters"]) == [(1, 1, 0, 1)]

    lines = spark.read.parquet(os.path.join(out, "report_lines"))
    text = [r["value"] for r in lines.orderBy("line_no").collect()]
    assert text[0] == "ENDPOINTS:" and "JSON:" in text and "STRING VARIABLES:" in text
    assert spark.read.json(os.path.join(out, "models")).count() == len(models)
