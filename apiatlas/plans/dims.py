"""Small static dimension tables (fixed values of the analysed domain)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# networking/JSON library ids and the code keywords that reveal
# them, in dictionary order. Seven ids have no keyword.
LIBRARY_KEYWORDS = [
    ("com.squareup.retrofit", ["Retrofit", "Retrofit.Builder", "RequestBody", "ResponseBody",
                               "@POST", "@GET", "@PUT", "@PATCH"]),
    ("com.squareup.retrofit2", []),
    ("com.squareup.okhttp", []),
    ("com.squareup.okhttp3", ["OkHttpClient", "Request.Builder", "newCall", "RequestBody.create"]),
    ("com.github.bumptech.glide", ["GlideApp", "Glide"]),
    ("org.apache.httpcomponents", ["HttpClients", "HttpClient", "HttpPost", "HttpGet", "HttpResponse",
                                   "httpclient.execute", "CloseableHttpResponse", "DefaultHttpClient"]),
    ("org.apache.http.legacy", []),
    ("cz.msebera.android", []),
    ("com.android.volley", ["RequestQueue", "Volley.newRequestQueue", "Volley", "StringRequest",
                            "Request.Method", "JsonObjectRequest", "JsonArrayRequest", "HttpHeaderParser"]),
    ("com.mcxiaoke.volley", []),
    ("com.loopj.android", ["AsyncHttpClient", "AsyncHttpResponseHandler", "JsonHttpResponseHandler",
                           "RequestParams", "FileAsyncHttpResponseHandler", "setBasicAuth", "AuthScope",
                           "prepareGet"]),
    ("com.koushikdutta.ion", ["Ion.with"]),
    ("com.koushikdutta.async", ["AsyncHttpServer", "AsyncServer", "AsyncHttpResponse", "AsyncHttpClient",
                                "WebSocketConnectCallback", "ConnectCallback", "SocketIOClient",
                                "AsyncHttpPost", "HttpServerRequestCallback"]),
    ("java.net.URLConnection", ["URLConnection", "openConnection()"]),
    ("java.net.HttpURLConnection", ["HttpURLConnection", "openConnection()", "setRequestMethod"]),
    ("javax.net.ssl.HttpsURLConnection", ["HttpsURLConnection", "setRequestMethod", "openConnection()"]),
    ("java.net.Socket", ["Socket", "SocketFactory"]),
    ("javax.net.ssl.SSLSocket", ["SSLSocket", "SSLSocketFactory"]),
    ("android.core", ["AndroidHttpClient", "DefaultHttpClient", "HttpGet", "HttpClient"]),
    ("com.google.code.gson", []),
    ("com.squareup.moshi", []),
]

# The same kind of dictionary for prose (licence lines, secrets, function words) and for the
# properties of events: the driver's texts hold no networking code.
PROSE_KEYWORDS = [
    ("licence.apache", ["Apache License", "Licensed under"]),
    ("licence.rights", ["all rights reserved"]),
    ("secret", ["TOKEN =", "api_key", "password"]),
    ("lang.en", [" the ", " and ", " of "]),
    ("lang.de", [" der ", " und "]),
    ("lang.fr", [" les ", " une "]),
    ("lang.es", [" los ", " una "]),
    ("markup", ["<div", "</p>"]),
]
EVENT_KEYWORDS = [("prop.k", ['"k"']), ("value.nine", ['"k": 9}', '"k": 99}']), ("value.missing", ["null"])]

# Extraction libraries that model counts always list (zero-filled).
MODEL_LIBRARIES = ["com.google.code.gson", "com.squareup.moshi", "org.json",
                   "noLib.StringLiteralExpr", "noLib.BinaryExpr"]

# HTTP methods of a request plan.
HTTP_METHODS = ["GET", "POST", "PUT", "PATCH", "DELETE"]


def library_dim(spark: SparkSession, table: list | None = None) -> DataFrame:
    """L4: (library, lib_order) — one row per library id."""
    return spark.createDataFrame([(lib, i) for i, (lib, _) in enumerate(table or LIBRARY_KEYWORDS)],
                                 "library string, lib_order int")


def keyword_pairs(table: list) -> list[tuple[str, str]]:
    """L4: (library, keyword) in dictionary order; libraries without keywords have none."""
    return [(lib, kw) for lib, kws in table for kw in kws]


def model_library_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in MODEL_LIBRARIES], "library string")


# Call-site rules (kind, name, match, type, min_args, library).
# match: "result" = type of the expression, "scope" = type of the call's scope,
# "arg" = one argument has this type, NULL = name alone. Library NULL = the
# matched type itself.
CALL_RULES = [
    ("creation", "JsonObjectRequest", "arg", "Response.Listener", 3, "com.android.volley"),
    ("creation", "JsonArrayRequest", "arg", "Response.Listener", 3, "com.android.volley"),
    ("creation", "StringRequest", "arg", "Response.Listener", 3, "com.android.volley"),
    ("creation", "ImageRequest", "arg", "Response.Listener", 3, "com.android.volley"),
    ("creation", "Builder", "result", "okhttp3.Request.Builder", None, "com.squareup.okhttp3"),
    ("creation", "Builder", "result", "com.squareup.okhttp.Request.Builder", None, "com.squareup.okhttp"),
    ("creation", "Builder", "result", "retrofit.Retrofit.Builder", None, "com.squareup.retrofit"),
    ("creation", "Builder", "result", "retrofit2.Retrofit.Builder", None, "com.squareup.retrofit"),
    ("creation", "Builder", "result", "retrofit.RestAdapter.Builder", None, "com.squareup.retrofit"),
    ("creation", "Builder", "result", "retrofit2.RestAdapter.Builder", None, "com.squareup.retrofit"),
    ("creation", "Socket", "result", "java.net.Socket", None, "java.net.Socket"),
    ("creation", "SSLSocket", "result", "javax.net.ssl.SSLSocket", None, "javax.net.ssl.SSLSocket"),
    ("call", "openConnection", "result", "java.net.URLConnection", None, "java.net.URLConnection"),
    ("call", "openConnection", "result", "java.net.HttpURLConnection", None, "java.net.HttpURLConnection"),
    ("call", "openStream", "result", "java.net.URLConnection", None, "java.net.URLConnection"),
    ("call", "openStream", "result", "java.net.HttpURLConnection", None, "java.net.HttpURLConnection"),
    ("call", "execute", "scope", "org.apache.http.client.HttpClient", None, "org.apache.httpcomponents"),
    ("call", "execute", "scope", "org.apache.http.impl.client.CloseableHttpClient", None, "org.apache.httpcomponents"),
    ("call", "execute", "scope", "org.apache.http.impl.client.DefaultHttpClient", None, "org.apache.httpcomponents"),
    ("call", "execute", "scope", "android.net.http.AndroidHttpClient", None, "android.core"),
    ("call", "get", "arg", "com.loopj.android.http.AsyncHttpResponseHandler", 2, "com.loopj.android"),
    ("call", "post", "arg", "com.loopj.android.http.AsyncHttpResponseHandler", 2, "com.loopj.android"),
    ("call", "with", "result", "com.koushikdutta.ion.builder.LoadBuilder", None, "com.koushikdutta.ion"),
    ("call", "with", "scope", "com.bumptech.glide.Glide", None, "com.github.bumptech.glide"),
    ("call", "with", "scope", "com.koushikdutta.ion.Ion", None, "com.koushikdutta.ion"),
    ("cast", "HttpURLConnection", "scope", "java.net.URLConnection", None, "java.net.HttpURLConnection"),
    ("cast", "HttpsURLConnection", "scope", "java.net.URLConnection", None, "javax.net.ssl.HttpsURLConnection"),
]


# Call rules by name alone, for the script calls of web pages.
PAGE_RULES = [("call", "track", None, None, 1, "page.analytics"), ("call", "track", None, None, 2, "page.analytics.two"),
              ("creation", "Date", None, None, None, "page.dates")]


def call_rule_dim(spark: SparkSession, rules: list | None = None) -> DataFrame:
    return spark.createDataFrame(rules or CALL_RULES, "kind string, name string, match string, type string, "
                                             "min_args int, library string")
