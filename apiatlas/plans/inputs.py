"""Stand-in inputs: the driver's tables re-shaped into the fact-table schemas the
jobs expect (candidate strings, definitions, uses, routes, build files, ...).

These functions project, rename and, where a fact has a coarser grain than a
table row, group the driver's tables; none of them performs the job that
consumes it. Every job must be right on any data of the same schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# project = last label of the host (com / net / org), library = first path segment
PROJECT_OF_URL = r"^[^:]+://[^/?#]*\.([^./?#:]+)"
FIRST_SEGMENT = r"^[^:]+://[^/?#]+/([^/?#]*)"
URL_PATH = r"^[^:]+://[^/?#]+(/[^?#]*)?"
URL_QUERY = r"^[^?#]*\?([^#]*)"
URL_BASE = r"^([^:]+://[^/?#]+)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(df: DataFrame, col: str):
    """Seconds since 1970-01-01 of a timestamp column, independent of the session zone."""
    if isinstance(df.schema[col].dataType, T.TimestampNTZType):
        return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")
    return F.unix_seconds(F.col(col))


def page_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages.url -> candidate(project, path, line, library, text, ord, verb)."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    return p.select(
        F.regexp_extract("url", PROJECT_OF_URL, 1).alias("project"),
        F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("path"),
        F.lit(1).alias("line"),
        F.concat(F.lit("lang:"), F.regexp_extract("url", FIRST_SEGMENT, 1)).alias("library"),
        F.col("url").alias("text"),
        F.col("page_id").alias("ord"),
        F.lit(None).cast("string").alias("verb"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages.html as a corpus (project, path, content)."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id"), F.regexp_extract("url", PROJECT_OF_URL, 1).alias("project"),
        F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a corpus (project = source, path = doc_id, library = lang)."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("project"), F.col("doc_id").cast("string").alias("path"),
        F.col("lang").alias("library"), F.col("text").alias("content"))


def event_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.props -> candidate strings, project = event_type, ord = event_id."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("project"),
                    F.concat(F.lit("event/"), F.col("event_id").cast("string")).alias("path"),
                    F.lit("noLib.StringLiteralExpr").alias("library"),
                    F.col("props").alias("text"), F.col("event_id").alias("ord"))


def region_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested JSON text per region (its nations as an array), as candidates."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    nested = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(
        F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))).alias("nations"))
    doc = r.join(nested, r.r_regionkey == nested.n_regionkey, "left").select(
        F.lit("regions").alias("project"),
        F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("path"),
        F.lit("noLib.StringLiteralExpr").alias("library"),
        F.to_json(F.struct(F.col("r_name").alias("region"), F.col("r_regionkey").alias("id"),
                           F.coalesce("nations", F.array().cast("array<struct<key:int,name:string>>"))
                           .alias("nations"))).alias("text"),
        F.col("r_regionkey").cast("long").alias("ord"))
    return doc


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct path shapes of pages (numbers -> {id}) as annotated routes."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    qs = F.regexp_extract("url", URL_QUERY, 1)
    qkeys = F.when(qs == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(qs, "&"), lambda x: F.split(x, "=")[0]))
    shaped = p.select("page_id", F.regexp_extract("url", PROJECT_OF_URL, 1).alias("project"),
                      F.regexp_replace(F.regexp_extract("url", URL_PATH, 1), "[0-9]+", "{id}").alias("template"),
                      qkeys.alias("qkeys"))
    g = shaped.groupBy("project", "template", "qkeys").agg(F.min("page_id").alias("ord"))
    params = F.concat(
        F.array(F.struct(F.lit("Path").alias("ann"), F.lit("id").alias("arg"), F.lit("int").alias("type"),
                         F.lit(0).alias("pos"))),
        F.transform("qkeys", lambda k, i: F.struct(F.lit("Query").alias("ann"), k.alias("arg"),
                                                   F.lit("String").alias("type"), (i + 1).alias("pos"))))
    return g.select("project", F.col("project").alias("client"),
                    F.concat(F.lit("routes/"), F.col("project")).alias("path"),
                    F.lit("Pages").alias("iface"), F.concat(F.lit("r"), F.col("ord").cast("string")).alias("method"),
                    F.lit("GET").alias("verb"), "template", params.alias("params"), "qkeys", "ord")


def page_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("url")
    return p.select(F.regexp_extract("url", PROJECT_OF_URL, 1).alias("project"),
                    F.regexp_extract("url", URL_BASE, 1).alias("url")).distinct() \
        .withColumn("client", F.col("project")).withColumn("converter", F.lit(None).cast("string"))


def library_ids() -> list[str]:
    from apiatlas.plans.dims import LIBRARY_KEYWORDS
    return [lib for lib, _ in LIBRARY_KEYWORDS]


def part_group(brand_no):
    """Coordinate group of a part: the n-th library id for brands 1..21, else an unknown group."""
    ids = F.array(*[F.lit(x) for x in library_ids()])
    return F.coalesce(F.try_element_at(ids, brand_no), F.concat(F.lit("com.brand"), brand_no.cast("string")))


def part_build_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One build file per part (project = p_type, ord = p_partkey): an import
    line, an sdk line and one dependency coordinate ``<group>:<name>:<size>``."""
    p = table(spark, sf_dir, "part")
    brand_no = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int")
    coord = F.concat(part_group(brand_no), F.lit(":"), F.regexp_replace("p_name", " ", "-"), F.lit(":"),
                     F.col("p_size").cast("string"))
    return p.select(F.col("p_type").alias("project"), F.concat(F.lit("part/"), F.col("p_partkey").cast("string"))
                    .alias("path"), F.col("p_partkey").alias("ord"),
                    F.concat(F.lit("import org.gradle.X\nandroid {\n    compileSdkVersion "),
                             F.col("p_size").cast("string"), F.lit("\n}\ndependencies {\n    implementation '"),
                             coord, F.lit("'\n}\n")).alias("content"))


def part_library_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available library folders, one for every part: ``<group>-<size>``, for parts with an
    odd key ``<group>-<size>-beta``."""
    p = table(spark, sf_dir, "part")
    brand_no = F.regexp_extract("p_brand", r"#(\d+)", 1).cast("int")
    tail = F.when(F.col("p_partkey") % 2 == 1, F.lit("-beta")).otherwise(F.lit(""))
    return p.select(F.concat(part_group(brand_no), F.lit("-"), F.col("p_size").cast("string"), tail).alias("folder")).distinct()


def page_builder_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL-builder calls for each page URL: scheme, host, one addPathSegment per
    segment, one addQueryParameter per pair, fragment."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    b = F.col("page_id").cast("string")
    path = F.regexp_extract("url", URL_PATH, 1)
    qs = F.regexp_extract("url", URL_QUERY, 1)
    frag = F.regexp_extract("url", r"#(.*)$", 1)
    head = p.select(b.alias("builder"), F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("scheme").alias("step"),
                 F.array(F.regexp_extract("url", r"^([^:]+)://", 1)).alias("alts"),
                 F.lit(None).cast("array<string>").alias("alts2")),
        F.struct(F.lit(1).alias("pos"), F.lit("host").alias("step"),
                 F.array(F.regexp_extract("url", r"^[^:]+://([^/?#]+)", 1)).alias("alts"),
                 F.lit(None).cast("array<string>").alias("alts2")))).alias("s"))
    segs = p.select(b.alias("builder"), F.posexplode(F.split(path, "/")).alias("i", "seg")).filter("i > 0") \
        .select("builder", F.struct((F.col("i") + 1).alias("pos"), F.lit("addPathSegment").alias("step"),
                                    F.array("seg").alias("alts"),
                                    F.lit(None).cast("array<string>").alias("alts2")).alias("s"))
    qp = p.filter(qs != "").select(b.alias("builder"), F.posexplode(F.split(qs, "&")).alias("i", "kv")) \
        .select("builder", F.struct((F.col("i") + 1000).alias("pos"), F.lit("addQueryParameter").alias("step"),
                                    F.array(F.substring_index("kv", "=", 1)).alias("alts"),
                                    F.array(F.when(F.contains("kv", F.lit("=")), F.expr("substr(kv, instr(kv, '=') + 1)"))
                                            .otherwise(F.lit(""))).alias("alts2")).alias("s"))
    fr = p.filter(F.col("url").contains("#")).select(b.alias("builder"), F.struct(
        F.lit(100000).alias("pos"), F.lit("fragment").alias("step"), F.array(frag).alias("alts"),
        F.lit(None).cast("array<string>").alias("alts2")).alias("s"))
    allsteps = head.unionByName(segs).unionByName(qp).unionByName(fr)
    return allsteps.select(F.lit("pages").alias("project"), F.lit("pages").alias("path"), "builder", "s.*")


def part_class_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class fields: one class per part type, one field per part name in it.
    The field type follows the smallest size: String, int, Double, a list of
    the next type's class, or the next type's class itself (types in name
    order; the last type has no next class);
    Brand#1 parts are transient, Brand#2 parts carry a SerializedName."""
    p = table(spark, sf_dir, "part")
    types = p.select("p_type").distinct()
    after = types.select(F.col("p_type").alias("later"))
    nxt = types.join(after, F.col("later") > F.col("p_type")).groupBy("p_type").agg(F.min("later").alias("nxt"))
    g = p.groupBy("p_type", "p_name").agg(F.min("p_size").alias("s"), F.min("p_brand").alias("b")).join(nxt, "p_type", "left")
    cls = F.initcap(F.lower("p_type"))
    next_cls = F.initcap(F.lower("nxt"))
    typ = (F.when(F.col("s") <= 10, "String").when(F.col("s") <= 20, "int")
           .when((F.col("s") <= 30) | next_cls.isNull(), "Double")
           .when(F.col("s") <= 40, "List").otherwise(next_cls))
    ann = F.when(F.col("b") == "Brand#2", F.array(F.struct(F.lit("SerializedName").alias("name"),
                                                             F.lit(None).cast("string").alias("key"),
                                                             F.upper(F.regexp_replace("p_name", " ", "_"))
                                                             .alias("value")))) \
        .otherwise(F.array().cast("array<struct<name:string,key:string,value:string>>"))
    return g.select(F.lit("tpch").alias("project"), cls.alias("class"),
                    F.regexp_replace("p_name", " ", "_").alias("field"), typ.alias("type"),
                    F.when(F.col("s").between(31, 40), F.array(next_cls)).otherwise(F.array().cast("array<string>"))
                    .alias("type_args"),
                    F.lit(False).alias("is_enum"), (F.col("b") == "Brand#1").alias("is_transient"),
                    ann.alias("annotations"))


def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per part (project = p_brand): an import, a comment, a class with a
    renamed field, a static one, a local, and an interface with one route."""
    p = table(spark, sf_dir, "part")
    n, name = F.col("p_partkey").cast("string"), F.regexp_replace("p_name", " ", "_")
    lib = F.element_at(F.array(*[F.lit(x) for x in library_ids()]), (F.col("p_partkey") % len(library_ids()) + 1).cast("int"))
    text = F.concat(
        F.lit("package p;\nimport "), lib, F.lit(".X;\n// import java.net.Socket; String gone;\npublic class Part"), n,
        F.lit(" {\n  static final int SIZE = "), F.col("p_size").cast("string"), F.lit(";\n  @SerializedName(\""), F.col("p_name"),
        F.lit("\") private "), F.when(F.col("p_size") > 25, "int").otherwise("String"), F.lit(" "), name,
        F.lit(";\n  void run() { String local = \"x\"; return; }\n}\ninterface Api"), n,
        F.lit(" {\n  @GET(\"parts/{id}/"), F.lower("p_type"), F.lit("\")\n  Call<Part> get"), n,
        F.lit("(@Path(\"id\") int id, @QueryMap Map<String, String> m, @Query(\"size\") "),
        F.when(F.col("p_size") % 2 == 0, "Integer").otherwise("String"), F.lit(" size);\n}\n"))
    return p.select(F.col("p_brand").alias("project"), F.concat(F.lit("Part"), n, F.lit(".java")).alias("path"), text.alias("content"))


def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request chains: one per order, its line numbers as calls in order; line 2 names the URL
    variable of the order, the others are verbs by their (smallest) return flag."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    call = F.when(F.col("l_linenumber") == 2, "url").when(F.col("l_returnflag") == "A", "post") \
        .when(F.col("l_returnflag") == "R", "delete").otherwise("header")
    return li.select(F.lit("tpch").alias("project"), F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("pos"),
                     call.alias("call"), F.when(F.col("l_linenumber") == 2, F.concat(F.lit("b"), F.col("l_orderkey").cast("string"))).alias("arg"))


def order_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URL text of each order's builder."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit("tpch").alias("project"), F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("builder"),
                    F.concat(F.lit("http://shop.com/c/"), F.col("o_custkey").cast("string")).alias("text"))


def page_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per page (project = page_id mod 7) that takes its URL's base and path apart over a
    constant, a method, a String builder handed to another method, a URL builder and a request."""
    p = table(spark, sf_dir, "pages").select("page_id", "url").filter(F.col("url").contains("://"))
    n, base = F.col("page_id").cast("string"), F.regexp_extract("url", URL_BASE, 1)
    host = F.regexp_extract("url", r"^[^:]+://([^/?#]+)", 1)
    verb = F.element_at(F.array(*[F.lit(v) for v in ("post", "put", "delete")]), (F.col("page_id") % 3 + 1).cast("int"))
    text = F.concat(
        F.lit("package app.net;\nimport okhttp3.*;\nimport org.apache.http.client.HttpClient;\npublic class Page"), n,
        F.lit(" {\n  // String gone = \"x\";\n  static final String BASE = \""), base, F.lit("\", KIND = \"k"), (F.col("page_id") % 5).cast("string"),
        F.lit("\";\n  private String path(String tail) {\n    return \"/p/\" + tail;\n  }\n  void open(HttpClient client, RequestBody body) throws Exception {\n"
              "    String whole = BASE + path(\""), n, F.lit("\");\n    StringBuilder sb = new StringBuilder();\n    sb.append(BASE).append(\"/\");\n"
              "    tail(sb, \"id"), n, F.lit("\");\n    sb.append(\"?q=\" + KIND);\n    load(sb.toString());\n"
              "    HttpUrl url = new HttpUrl.Builder().scheme(\"http\").host(\""), host, F.lit("\").addPathSegment(\"b c\").addQueryParameter(\"n\", \""), n,
        F.lit("\").build();\n    client.execute(new Request.Builder().url(url)."), verb, F.lit("(body).build());\n  }\n"
              "  private void tail(StringBuilder target, String name) {\n    target.append(name);\n  }\n}\n"))
    return p.select((F.col("page_id") % 7).cast("string").alias("project"), F.concat(F.lit("Page"), n, F.lit(".java")).alias("path"), text.alias("content"))
