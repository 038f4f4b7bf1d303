"""Registered queries: each job of the inventory run over the driver's tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame with scalar
columns only (lists and maps are rendered as sorted text), named exactly as in
the matching oracle SQL (``apiatlas.plans.oracle``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiatlas.operators import facts, jsonmodel, libraries, program, resolve, samples, stats
from apiatlas.operators import urls as U
from apiatlas.plans import dims
from apiatlas.plans import inputs as I
from apiatlas.session import ensure_checkpoint_dir
from apiatlas.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]


# ------------------------------------------------------------------ URL catalog
def q_decompose_urls(spark, sf):
    d = U.decompose_urls(I.page_candidates(spark, sf))
    return d.select("ord", "project", "base_url", "scheme", "authority", "endpoint",
                    U.query_string(F.col("queries")).alias("query_string"),
                    U.joined(F.col("fragments")).alias("fragments"))


def q_url_query_pairs(spark, sf):
    return U.url_query_pairs(I.page_candidates(spark, sf))


def q_build_url_catalog(spark, sf):
    return U.flatten_catalog(U.build_url_catalog(I.page_candidates(spark, sf)))


def q_rebuild_urls(spark, sf):
    return U.rebuild_urls(U.build_url_catalog(I.page_candidates(spark, sf)))


def _expanded_routes(spark, sf):
    return U.expand_routes(I.page_routes(spark, sf))


def q_expand_routes(spark, sf):
    return _expanded_routes(spark, sf).select(
        "project", "template", F.array_join("qkeys", ",").alias("qkeys"), "verb", "route_url")


def q_join_base_urls(spark, sf):
    j = U.join_base_urls(_expanded_routes(spark, sf), I.page_bases(spark, sf))
    return j.select("project", "base", "verb", F.col("text").alias("url"))


# ------------------------------------------------------------------ extraction
def q_extract_literals(spark, sf):
    lits = facts.extract_literals(I.page_texts(spark, sf), keys=("page_id",))
    return lits.select("page_id", "line", "pos", "literal", "kind")


def q_collect_string_vars(spark, sf):
    v = facts.collect_string_vars(I.document_texts(spark, sf), pattern=facts.STRING_ASSIGNMENT)
    return v.select("project", "name", F.size("values").cast("long").alias("n_values"),
                    F.array_join("values", "|").alias("vals"))


def q_match_keywords(spark, sf):
    m = libraries.match_keywords(I.document_texts(spark, sf), dims.keyword_pairs(dims.PROSE_KEYWORDS))
    return m.select("project", "path", "library", F.col("n_keywords").cast("long").alias("n_keywords"))


def q_files_without_snippets(spark, sf):
    docs = I.document_texts(spark, sf)
    imports = docs.select("project", "path", "library")
    snippets = facts.string_var_sites(docs, pattern=facts.STRING_ASSIGNMENT)
    return libraries.files_without_snippets(imports, snippets)


def q_keep_maximal_spans(spark, sf):
    li = I.table(spark, sf, "lineitem")
    spans = li.select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("span_start"),
                      (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("span_end"))
    return facts.keep_maximal_spans(spans, "path", "span_start", "span_end")


# ------------------------------------------------------------------ resolution
def q_enclosing_block(spark, sf):
    ev = I.table(spark, sf, "events")
    pos = ev.select(F.col("event_id").alias("id"), F.concat(F.lit("user/"), F.col("user_id").cast("string"))
                    .alias("path"), I.epoch_seconds(ev, "ts").alias("pos"), "event_type")
    methods = pos.groupBy("path", F.col("event_type").alias("name")).agg(
        F.min("pos").alias("start_line"), F.max("pos").alias("end_line")).withColumn("kind", F.lit("method"))
    classes = methods.groupBy("path").agg(F.min("start_line").alias("start_line"),
                                          F.max("end_line").alias("end_line")) \
        .withColumn("name", F.lit("user")).withColumn("kind", F.lit("class"))
    blocks = methods.unionByName(classes)
    return resolve.enclosing_block(pos, blocks, bucket_width=86400, id_cols=("id",))


def q_fold_appends(spark, sf):
    li = I.table(spark, sf, "lineitem")
    app = li.select(F.lit("tpch").alias("project"), F.col("l_orderkey").alias("builder"),
                    F.col("l_linenumber").alias("pos"), F.array("l_returnflag").alias("alts"))
    return resolve.fold_appends(app)


def q_fold_appends_through_calls(spark, sf):
    """Customers hand their builder to orders, orders to their lines; each appends what it knows."""
    o, li = I.table(spark, sf, "orders"), I.table(spark, sf, "lineitem")
    var = lambda kind, *keys: F.concat(F.lit(kind), F.concat_ws("_", *[F.col(k).cast("string") for k in keys]))
    cust, order, line = var("cust", "o_custkey"), var("order", "o_orderkey"), var("line", "l_orderkey", "l_linenumber")
    step = lambda df, v, pos, text: df.select(F.lit("tpch").alias("project"), v.alias("builder"), F.lit(pos).alias("pos"), F.array(text).alias("alts"))
    appends = step(o.select("o_custkey").distinct(), cust, -1, F.lit("C")).unionByName(step(o, order, 0, F.col("o_orderstatus"))) \
        .unionByName(step(li, line, 1, F.lower("l_returnflag")))
    passes = o.select(F.lit("tpch").alias("project"), cust.alias("var"), F.col("o_orderkey").cast("int").alias("pos"), order.alias("callee_var")).unionByName(
        li.select(F.lit("tpch").alias("project"), var("order", "l_orderkey").alias("var"), F.col("l_linenumber").cast("int").alias("pos"), line.alias("callee_var")))
    return resolve.fold_appends(appends, passes)


def q_source_texts(spark, sf):
    out = program.source_candidates(program.Program(I.page_sources(spark, sf)))
    return out["texts"].select("project", "path", "line", "library", "text").distinct()


def q_source_urls(spark, sf):
    out = program.source_candidates(program.Program(I.page_sources(spark, sf)))
    return out["urls"].select("project", "path", "library", "text", "verb")


def q_source_blocks(spark, sf):
    return program.extract_blocks(program.source_facts(I.page_sources(spark, sf)))


def q_string_declarations(spark, sf):
    v = facts.collect_string_vars(I.page_sources(spark, sf))
    return v.select("project", "name", F.size("values").cast("long").alias("n_values"), F.array_join("values", "|").alias("vals"))


def q_typed_call_rules(spark, sf):
    sources = I.page_sources(spark, sf)
    calls = program.typed_calls(program.Program(sources), sources, [r[3] for r in dims.CALL_RULES if r[3]])
    m = libraries.match_call_rules(calls, dims.call_rule_dim(spark))
    return m.select("project", "path", "line", "kind", "name", "scope_type", "result_type", "library")


def q_corpus_schema(spark, sf):
    """Parts as documents of three shapes, whose sizes are numbers, objects or texts."""
    p = I.table(spark, sf, "part")
    name = F.concat(F.lit('{"name":"'), F.col("p_name"), F.lit('",'))
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") % 3 == 0, F.concat(name, F.lit('"size":'), size, F.lit("}"))) \
        .when(F.col("p_size") % 3 == 1, F.concat(name, F.lit('"dim":{"w":['), size, F.lit("]}}"))).otherwise(F.concat(F.lit('{"size":"'), size, F.lit('"}')))
    return jsonmodel.corpus_schema(p.select(F.concat_ws("/", "p_brand", "p_type").alias("project"), text.alias("canonical")))


# ------------------------------------------------------------------ files
def _folder(spark) -> str:
    """A new folder below the cluster's shared one."""
    return f"{ensure_checkpoint_dir(spark)}/files/{uuid.uuid4().hex}"


def _page_files(spark, sf) -> str:
    """The URLs of pages as text files, a folder for each project (page_id mod 7)."""
    root = _folder(spark)
    p = I.table(spark, sf, "pages").filter("url IS NOT NULL")
    p.select((F.col("page_id") % 7).cast("string").alias("project"), "url").write.partitionBy("project").text(root)
    return root


def q_read_corpus(spark, sf):
    c = readers.read_corpus(spark, _page_files(spark, sf), "*.txt")
    return c.groupBy(F.regexp_replace("project", "project=", "").alias("project")).agg(
        F.sum(F.size(F.split("content", "\n")) - 1).alias("n_lines"), F.sum(F.length("content").cast("long")).alias("n_chars"))


def q_list_files(spark, sf):
    f = readers.list_files(spark, _page_files(spark, sf), ".txt")
    return f.groupBy(F.regexp_extract("path", "project=([^/]+)/", 1).alias("project")).agg(F.sum("length").alias("n_bytes"))


def q_read_packages(spark, sf):
    path = _folder(spark)
    I.table(spark, sf, "part").select(F.regexp_replace("p_name", " ", ".").alias("package_name"), F.col("p_size").alias("version")) \
        .write.option("header", True).csv(path)
    return readers.read_packages(spark, path)


def q_write_snippets(spark, sf):
    """Documents as snippets of their language's log; languages of fewer than 200 documents are no library."""
    path = _folder(spark)
    docs = I.document_texts(spark, sf).select("project", "path", "library")
    known = docs.groupBy("library").agg(F.count("*").alias("n")).filter("n >= 200").select("library")
    sinks.write_snippets(docs, known, path)
    return spark.read.schema("project string, path string, library string").json(path).select("project", "path", "library")


def q_write_models(spark, sf):
    path = _folder(spark)
    sinks.write_models(_event_models(spark, sf).select("project", "library", "canonical"), path)
    m = spark.read.schema("project string, library string, canonical string").json(path)
    return m.groupBy("project", "library").agg(F.count("canonical").alias("n_models"))


def q_fuzzy_fill_json(spark, sf):
    p = I.table(spark, sf, "part")
    jtype = F.element_at(F.array(*[F.lit(t) for t in ("STRING", "NUMBER_INT", "BOOLEAN", "NUMBER_DOUBLE")]), (F.col("p_size") % 4 + 1).cast("int"))
    fields = p.select(F.col("p_brand").alias("project"), F.col("p_partkey").cast("string").alias("model_id"), F.col("p_name").alias("key"),
                      jtype.alias("jtype"), F.when(F.col("p_partkey") % 3 == 0, F.lit("known")).alias("value"))
    svars = p.groupBy(F.col("p_brand").alias("project"), F.col("p_type").alias("name")).agg(F.sort_array(F.collect_set("p_name")).alias("values"))
    return samples.fuzzy_fill_json(fields, svars).select("project", "model_id", "key", "jtype", "value")


def q_expand_concat(spark, sf):
    li = I.table(spark, sf, "lineitem")
    nation = I.table(spark, sf, "nation")
    region = I.table(spark, sf, "region")
    resolved = li.agg(F.collect_set("l_returnflag").alias("f"), F.collect_set("l_linestatus").alias("s")) \
        .select(F.explode(F.array(F.struct(F.lit("flag").alias("ref"), F.col("f").alias("alternatives")),
                                  F.struct(F.lit("status").alias("ref"), F.col("s").alias("alternatives"))))
                .alias("r")).select(F.lit("tpch").alias("project"), "r.*")
    nat = nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("expr_id"), "n_name")
    lit = lambda v: F.lit(v).cast("string")

    def part(pos, kind, literal, ref):
        return F.struct(F.lit(pos).alias("pos"), lit(kind).alias("part_kind"), literal.alias("literal"),
                        ref.alias("ref"))
    parts = nat.select("expr_id", F.explode(F.array(
        part(0, "ref", lit(None), lit("flag")),
        part(1, "literal", lit("-"), lit(None)),
        part(2, "ref", lit(None), lit("status")),
        part(3, "literal", lit("@"), lit(None)),
        part(4, "literal", F.col("n_name"), lit(None)))).alias("p")).select("expr_id", "p.*")
    # region expressions reference a name nothing defines: they must drop
    reg = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("expr_id"), "r_name") \
        .select("expr_id", F.explode(F.array(
            part(0, "literal", F.col("r_name"), lit(None)),
            part(1, "ref", lit(None), lit("undefined")))).alias("p")).select("expr_id", "p.*")
    parts = parts.unionByName(reg).withColumn("project", F.lit("tpch"))
    return resolve.expand_concat(parts, resolved)


def _order_defs_uses(spark, sf):
    o = I.table(spark, sf, "orders")
    c = I.table(spark, sf, "customer")
    defs = o.select(F.lit("tpch").alias("project"), F.lit("Customer.java").alias("path"),
                    F.lit("Customer").alias("class"),
                    F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("method"),
                    F.lit("order").alias("name"), F.lit("local").alias("kind"),
                    F.when(F.col("o_orderstatus") == "F", "init").otherwise("assign").alias("role"),
                    F.when(F.col("o_orderpriority").startswith("5"), "null").otherwise("literal").alias("value_kind"),
                    F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("expr_id"))
    uses = c.select(F.lit("tpch").alias("project"), F.lit("Customer.java").alias("path"),
                    F.lit("Customer").alias("class"),
                    F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("method"),
                    F.lit("order").alias("name"),
                    F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("expr_id"))
    return defs, uses


def q_resolve_local(spark, sf):
    defs, uses = _order_defs_uses(spark, sf)
    return resolve.resolve_local(uses, defs).select("project", "use_id", "def_id")


def _part_field_defs(spark, sf):
    p = I.table(spark, sf, "part")
    vis = (F.when(F.col("p_size") <= 12, "public").when(F.col("p_size") <= 25, "protected")
           .when(F.col("p_size") <= 37, "default").otherwise("private"))
    return p.select(F.lit("tpch").alias("project"),
                    F.when(F.col("p_type") == "PROMO", F.lit(None).cast("string"))
                    .otherwise(F.concat(F.lit("pkg"), F.expr("p_size div 10").cast("string"))).alias("package"),
                    F.concat(F.lit("file"), F.col("p_size").cast("string")).alias("path"),
                    F.concat(F.lit("C"), F.col("p_size").cast("string")).alias("class"),
                    F.lit(None).cast("string").alias("method"),
                    F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("name"),
                    F.lit("field").alias("kind"), F.lit("init").alias("role"), vis.alias("visibility"),
                    F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("expr_id"))


def q_resolve_field(spark, sf):
    li = I.table(spark, sf, "lineitem")
    uses = li.select(F.lit("tpch").alias("project"),
                     F.concat(F.lit("pkg"), (F.col("l_linenumber") - 1).cast("string")).alias("package"),
                     F.concat(F.lit("file"), F.col("l_suppkey").cast("string")).alias("path"),
                     F.lit("run").alias("method"),
                     F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("name"),
                     F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("_"),
                              F.col("l_linenumber").cast("string")).alias("expr_id"))
    return resolve.resolve_field(uses, _part_field_defs(spark, sf))


def q_resolve_param(spark, sf):
    p = I.table(spark, sf, "part")
    li = I.table(spark, sf, "lineitem")
    params = p.select(F.lit("tpch").alias("project"), F.concat(F.lit("file"), F.col("p_size").cast("string")).alias("path"),
                      F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("callee"),
                      F.when(F.col("p_size") <= 25, "public").otherwise("private").alias("visibility"),
                      F.explode(F.array(F.struct(F.lit(0).alias("arg_pos"), F.lit("qty").alias("name")),
                                        F.struct(F.lit(1).alias("arg_pos"), F.lit("disc").alias("name")))).alias("a")) \
        .select("project", "path", "callee", "visibility", "a.arg_pos", "a.name")
    line_id = F.concat(F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))
    args = li.select(F.lit("tpch").alias("project"), F.concat(F.lit("file"), F.col("l_suppkey").cast("string")).alias("path"),
                     F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("callee"),
                     F.explode(F.array(
                         F.struct(F.lit(0).alias("arg_pos"), F.concat(F.lit("q"), line_id).alias("expr_id"),
                                  F.lit("literal").alias("arg_kind")),
                         F.struct(F.lit(1).alias("arg_pos"), F.concat(F.lit("d"), line_id).alias("expr_id"),
                                  F.when(F.col("l_discount") == 0, "other").otherwise("literal").alias("arg_kind"))))
                     .alias("a")) \
        .select("project", "path", "callee", "a.arg_pos", "a.expr_id", "a.arg_kind")
    return resolve.resolve_param(params, args)


def q_resolve_iterative(spark, sf):
    p = I.table(spark, sf, "part").select("p_partkey", "p_size")
    name = F.concat(F.lit("v"), F.col("p_partkey").cast("string"))
    refs = p.filter(F.col("p_partkey") >= 2).select(
        F.lit("tpch").alias("project"), name.alias("name"), F.lit("name").alias("value_kind"),
        F.lit(None).cast("string").alias("value"),
        F.concat(F.lit("v"), F.expr("p_partkey div 2").cast("string")).alias("ref"))
    roots = p.filter(F.col("p_partkey") == 1).select(
        F.lit("tpch").alias("project"), name.alias("name"), F.lit("literal").alias("value_kind"),
        F.lit("root").alias("value"), F.lit(None).cast("string").alias("ref"))
    lits = p.filter(F.col("p_size") <= 5).select(
        F.lit("tpch").alias("project"), name.alias("name"), F.lit("literal").alias("value_kind"),
        F.concat(F.lit("L"), F.col("p_partkey").cast("string")).alias("value"), F.lit(None).cast("string").alias("ref"))
    defs = refs.unionByName(roots).unionByName(lits)
    starts = p.select(F.lit("tpch").alias("project"), name.alias("start"), name.alias("name"))
    return resolve.resolve_iterative(starts, defs)


def q_resolve_values(spark, sf):
    """URLs of orders: base of the customer's nation + path of the customer + the order's query."""
    c, o, n = (I.table(spark, sf, t) for t in ("customer", "orders", "nation"))
    i = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    none = F.lit(None).cast("string")
    rows = lambda df, e, kind, value=none, typ=none: df.select(
        F.lit("tpch").alias("project"), e.alias("expr_id"), F.lit(kind).alias("kind"), value.alias("value"), typ.alias("declared_type"))
    exprs = rows(n, i("n", "n_nationkey"), "literal", F.concat(F.lit("http://"), F.lower("n_name"), F.lit("/"))) \
        .union(rows(c, i("base", "c_custkey"), "name")).union(rows(c, i("path", "c_custkey"), "concat")) \
        .union(rows(c, i("lit", "c_custkey"), "literal", i("c", "c_custkey"))).union(rows(o, i("url", "o_orderkey"), "concat")) \
        .union(rows(o, i("q", "o_orderkey"), "param", none, F.when(F.col("o_orderkey") % 3 == 0, "int").when(F.col("o_orderkey") % 3 == 1, "String")))
    link = lambda df, a, b: df.select(F.lit("tpch").alias("project"), a.alias("use_id"), b.alias("def_id"))
    links = link(c, i("base", "c_custkey"), i("n", "c_nationkey"))
    part = lambda df, e, pos, p: df.select(F.lit("tpch").alias("project"), e.alias("expr_id"), F.lit(pos).alias("pos"), p.alias("part_id"))
    parts = part(c, i("path", "c_custkey"), 0, i("base", "c_custkey")).union(part(c, i("path", "c_custkey"), 1, i("lit", "c_custkey"))) \
        .union(part(o, i("url", "o_orderkey"), 0, i("path", "o_custkey"))).union(part(o, i("url", "o_orderkey"), 1, i("q", "o_orderkey")))
    out = resolve.resolve_values(exprs, links, parts)
    return out.join(o.select(i("url", "o_orderkey").alias("expr_id")), "expr_id", "left_semi")


# ------------------------------------------------------------------ JSON
def _event_models(spark, sf):
    return jsonmodel.build_json_models(I.event_candidates(spark, sf))


def _all_models(spark, sf):
    cands = I.event_candidates(spark, sf).unionByName(I.region_documents(spark, sf))
    return jsonmodel.build_json_models(cands)


def q_build_json_models(spark, sf):
    return _event_models(spark, sf).select("project", "model_id", "canonical", "first_ord", "path",
                                           "library", "n_occurrences")


def q_explode_json_fields(spark, sf):
    f = jsonmodel.explode_json_fields(_all_models(spark, sf))
    return f.select("project", "model_id", "path", "parent_path", "key", "idx", "depth", "jtype", "value")


def q_field_usage(spark, sf):
    return stats.field_usage(jsonmodel.explode_json_fields(_all_models(spark, sf))) \
        .select("key", F.col("n").cast("long").alias("n"))


def q_json_skeleton(spark, sf):
    sk = jsonmodel.json_skeleton(jsonmodel.explode_json_fields(_all_models(spark, sf)))
    return sk.select("project", "model_id", "skeleton")


def q_fold_json_puts(spark, sf):
    ev = I.table(spark, sf, "events")
    puts = ev.select(F.lit("events").alias("project"), F.col("user_id").alias("object"),
                     F.struct("ts", "event_id").alias("pos"), F.col("event_type").alias("key"),
                     F.col("value").cast("string").alias("value"), F.lit("number").alias("value_type"))
    return jsonmodel.fold_json_puts(puts).select("project", "object", "n_keys", "doc")


# ------------------------------------------------------------------ samples
def q_fill_placeholders(spark, sf):
    p = I.table(spark, sf, "part")
    t = p.select("p_partkey", F.concat(
        F.lit("/api/"), F.lower("p_type"), F.lit("/<Integer>?name=<String>&size="),
        F.when(F.col("p_size") > 25, "<Double>").otherwise("<BOOLEAN>"), F.lit("#<Float>")).alias("text"))
    return samples.fill_placeholders(t.withColumn("filled", F.col("text")), ["filled"])


def q_fuzzy_fill_queries(spark, sf):
    p = I.table(spark, sf, "part")
    value = F.when(F.col("p_size") % 3 == 0, "<STRING>").when(F.col("p_size") % 3 == 1, "<INTEGER>").otherwise("fixed")
    pairs = p.select(F.col("p_brand").alias("project"), F.col("p_name").alias("key"), value.alias("value")).distinct()
    svars = p.groupBy(F.col("p_brand").alias("project"), F.col("p_type").alias("name")) \
        .agg(F.sort_array(F.collect_set("p_name")).alias("values"))
    return samples.fuzzy_fill_queries(pairs, svars).select("project", "key", "value")


def q_request_plan(spark, sf):
    cat = U.build_url_catalog(I.page_candidates(spark, sf))
    eps = U.rebuild_urls(cat).select("project", F.col("populated_url").alias("url"))
    cand = I.page_candidates(spark, sf)
    bodies = cand.select("project", F.concat(F.lit('{"lang":"'), F.regexp_replace("library", "^lang:", ""),
                                             F.lit('"}')).alias("body")).distinct()
    return samples.request_plan(eps, bodies, dims.HTTP_METHODS)


# ------------------------------------------------------------------ statistics
def q_library_usage(spark, sf):
    m = libraries.match_keywords(I.document_texts(spark, sf), dims.keyword_pairs(dims.PROSE_KEYWORDS))
    return stats.library_usage(m, dims.library_dim(spark, dims.PROSE_KEYWORDS))


def q_models_per_library(spark, sf):
    return stats.models_per_library(_event_models(spark, sf), dims.model_library_dim(spark))


def q_project_counters(spark, sf):
    cands = I.event_candidates(spark, sf)
    libs = libraries.match_keywords(cands.withColumnRenamed("text", "content"), dims.keyword_pairs(dims.EVENT_KEYWORDS))
    return stats.project_counters(cands.select("project"), libs, _event_models(spark, sf))


def q_project_summary(spark, sf):
    cat = U.build_url_catalog(I.page_candidates(spark, sf))
    return stats.project_summary(_event_models(spark, sf), cat)


# ------------------------------------------------------------------ code facts and libraries
def q_extract_calls(spark, sf):
    c = facts.extract_calls(I.page_texts(spark, sf), keys=("page_id",))
    return c.select("page_id", "line", "pos", "kind", "name", "scope", F.size("args").cast("long").alias("n_args"))


def q_match_call_rules(spark, sf):
    c = facts.extract_calls(I.page_texts(spark, sf), keys=("page_id",))
    m = libraries.match_call_rules(c, dims.call_rule_dim(spark, dims.CALL_RULES + dims.PAGE_RULES))
    return m.select("page_id", "line", "pos", "kind", "name", "library")


def q_extract_routes(spark, sf):
    r = facts.extract_routes(I.part_sources(spark, sf))
    return r.select("project", "path", "iface", "method", "verb", "template", F.array_join(F.transform("params", lambda p: F.concat_ws(
        ":", p["ann"], p["arg"], p["type"], p["pos"].cast("string"))), ";").alias("params"))


def q_extract_fields(spark, sf):
    f = facts.extract_fields(I.part_sources(spark, sf))
    return f.select("project", "path", "class", "field", "type", "is_transient", "visibility",
                    F.col("annotations")[0]["value"].alias("renamed"))


def q_extract_imports(spark, sf):
    return facts.extract_imports(I.part_sources(spark, sf), dims.library_dim(spark)).select("project", "path", "import", "library")


def q_attach_http_method(spark, sf):
    m = U.attach_http_method(I.order_requests(spark, sf), I.order_urls(spark, sf))
    return m.select("project", "builder", "request", "text", "verb")


def q_extract_dependencies(spark, sf):
    return libraries.extract_dependencies(I.part_build_files(spark, sf), dims.library_dim(spark))


def q_match_available_version(spark, sf):
    deps = libraries.extract_dependencies(I.part_build_files(spark, sf), dims.library_dim(spark))
    return libraries.match_available_version(deps, I.part_library_folders(spark, sf), dims.library_dim(spark))


# ------------------------------------------------------------------ more URL jobs
def q_urls_from_candidates(spark, sf):
    p = I.table(spark, sf, "pages")
    exprs = p.select(F.lit("pages").alias("project"), F.col("page_id").cast("string").alias("expr_id"),
                     F.array("url", F.regexp_extract("url", I.URL_PATH, 1)).alias("alternatives"))
    return U.urls_from_candidates(exprs).select("project", "expr_id", "any_url",
                                                F.col("n_urls").cast("long").alias("n_urls"))


def q_assemble_urls(spark, sf):
    p = I.table(spark, sf, "pages")
    pid = F.col("page_id").cast("string")
    file_part = F.regexp_extract("url", r"^[^:]+://[^/?#]+(.*)$", 1)
    three = p.select(F.concat(F.lit("a"), pid).alias("expr_id"), F.lit(3).alias("n_args"), F.explode(F.array(
        F.struct(F.lit(0).alias("arg_pos"), F.array(F.regexp_extract("url", r"^([^:]+)://", 1)).alias("alternatives")),
        F.struct(F.lit(1).alias("arg_pos"), F.array(F.regexp_extract("url", r"^[^:]+://([^/?#]+)", 1))
                 .alias("alternatives")),
        F.struct(F.lit(2).alias("arg_pos"), F.array(file_part).alias("alternatives")))).alias("a"))
    two = p.select(F.concat(F.lit("b"), pid).alias("expr_id"), F.lit(2).alias("n_args"), F.explode(F.array(
        F.struct(F.lit(0).alias("arg_pos"), F.array(F.regexp_extract("url", I.URL_BASE, 1)).alias("alternatives")),
        F.struct(F.lit(1).alias("arg_pos"), F.array(file_part, F.lit("/")).alias("alternatives")))).alias("a"))
    parts = three.unionByName(two).select(F.lit("pages").alias("project"), "expr_id", "n_args", "a.arg_pos", "a.alternatives")
    return U.assemble_urls(parts)


def q_fold_builder_steps(spark, sf):
    return U.fold_builder_steps(I.page_builder_steps(spark, sf)).select("builder", "text")


def q_stream_url_catalog(spark, sf):
    """Catalog built by the streaming job (availableNow over the candidate files)."""
    import os
    import uuid
    from apiatlas.session import ensure_checkpoint_dir
    from apiatlas.streaming import catalog_stream as CS
    root = os.path.join(ensure_checkpoint_dir(spark), "stream-" + uuid.uuid4().hex)
    I.page_candidates(spark, sf).write.parquet(os.path.join(root, "source"))
    q = CS.stream_url_catalog(spark, os.path.join(root, "source"), os.path.join(root, "state"),
                              os.path.join(root, "checkpoint"))
    q.awaitTermination()
    return U.flatten_catalog(CS.current_catalog(spark, os.path.join(root, "state")))


# ------------------------------------------------------------------ more resolution
def q_resolve_return(spark, sf):
    c = I.table(spark, sf, "customer")
    o = I.table(spark, sf, "orders")
    calls = c.select(F.lit("tpch").alias("project"), F.concat(F.lit("ordersOf"), F.col("c_custkey").cast("string"))
                     .alias("callee"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("expr_id"))
    rets = o.select(F.lit("tpch").alias("project"), F.concat(F.lit("ordersOf"), F.col("o_custkey").cast("string"))
                    .alias("callee"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("expr_id"))
    return resolve.resolve_return(calls, rets)


def q_resolve_field_access(spark, sf):
    li = I.table(spark, sf, "lineitem")
    acc = li.select(F.lit("tpch").alias("project"), F.lit("Part").alias("class"),
                    F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("name"),
                    F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("_"),
                             F.col("l_linenumber").cast("string")).alias("expr_id"))
    defs = _part_field_defs(spark, sf).withColumn("class", F.lit("Part")) \
        .withColumn("role", F.when(F.col("visibility") == "private", "assign").otherwise("init"))
    return resolve.resolve_field_access(acc, defs)


def q_alias_through_params(spark, sf):
    o = I.table(spark, sf, "orders")
    li = I.table(spark, sf, "lineitem")
    e1 = o.select(F.lit("tpch").alias("project"), F.concat(F.lit("cust"), F.col("o_custkey").cast("string"))
                  .alias("caller_var"), F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("callee_var"))
    e2 = li.select(F.lit("tpch").alias("project"), F.concat(F.lit("order"), F.col("l_orderkey").cast("string"))
                   .alias("caller_var"), F.concat(F.lit("line"), F.col("l_orderkey").cast("string"), F.lit("_"),
                                                  F.col("l_linenumber").cast("string")).alias("callee_var"))
    return resolve.alias_through_params(e1.unionByName(e2)) \
        .select("project", "var", "root", F.col("depth").cast("long").alias("depth"))


# ------------------------------------------------------------------ more JSON
def q_nest_json_values(spark, sf):
    """Per user and day an object of that day's last values; per user one object of its days."""
    ev = I.table(spark, sf, "events")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(I.epoch_seconds(ev, "ts") / 86400).cast("int")).cast("string")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    inner = F.concat_ws("_", user, day)
    leaf = ev.select(F.lit("events").alias("project"), inner.alias("object"), F.struct("ts", "event_id").alias("pos"),
                     F.col("event_type").alias("key"), F.col("value").cast("string").alias("value"),
                     F.lit("number").alias("value_type"))
    refs = ev.select(F.lit("events").alias("project"), user.alias("object"), F.struct("ts", "event_id").alias("pos"),
                     day.alias("key"), inner.alias("value"), F.lit("object").alias("value_type"))
    return jsonmodel.nest_json_values(leaf.unionByName(refs)).select(
        "project", "object", F.col("n_keys").cast("long").alias("n_keys"), "doc")


def q_fold_reassigned_puts(spark, sf):
    """J4s: an error event starts a user's document anew."""
    ev = I.table(spark, sf, "events")
    puts = ev.select(F.lit("events").alias("project"), F.col("user_id").alias("object"), F.col("event_id").alias("pos"),
                     F.col("event_type").alias("key"), F.col("value").cast("string").alias("value"), F.lit("number").alias("value_type"),
                     (F.col("event_type") == "error").alias("is_new"))
    return jsonmodel.fold_json_puts(puts).select("project", "object", "doc_no", "n_keys", "doc")


def q_schema_from_fields(spark, sf):
    cf = I.part_class_fields(spark, sf)
    roots = cf.select("project", "class").distinct()
    return jsonmodel.schema_from_fields(cf, roots)


def q_converter_libraries(spark, sf):
    li = I.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    calls = li.select(F.lit("tpch").alias("project"), F.col("l_orderkey").alias("client"), F.col("l_linenumber").alias("pos"),
                      F.when(F.col("l_linenumber") % 4 == 0, "baseUrl").otherwise("addConverterFactory").alias("call"),
                      F.when(F.col("flag") == "A", "GsonConverterFactory").when(F.col("flag") == "R", "MoshiConverterFactory")
                      .otherwise("ScalarsConverterFactory").alias("arg_scope"))
    return jsonmodel.converter_libraries(calls)


def _part_serializer_calls(spark, sf):
    p = I.table(spark, sf, "part")
    scope = F.when(F.col("p_size") % 5 == 0, "Gson").when(F.col("p_size") % 5 == 1, "com.squareup.moshi.Moshi").otherwise("Parcel")
    return p.filter(F.col("p_type").isNotNull()).select(F.lit("tpch").alias("project"), F.initcap(F.lower("p_type")).alias("class"),
                                                        scope.alias("scope_type"))


def q_serializer_models(spark, sf):
    return jsonmodel.serializer_models(_part_serializer_calls(spark, sf), I.part_class_fields(spark, sf))


def q_request_body_class_models(spark, sf):
    """J7 with both branches: body texts and the classes of body parameters."""
    cands = I.event_candidates(spark, sf).select("project", "path", "text", "ord")
    types = I.table(spark, sf, "part").select(F.lit("tpch").alias("project"), F.initcap(F.lower("p_type")).alias("type"),
                                              F.lit(jsonmodel.MOSHI).alias("library")).distinct()
    return jsonmodel.request_body_models(cands, types, I.part_class_fields(spark, sf))


def q_request_body_models(spark, sf):
    cands = I.event_candidates(spark, sf).select("project", "path", "text", "ord")
    return jsonmodel.request_body_models(cands)


def q_read_report(spark, sf):
    from apiatlas.sources import readers, sinks
    urls = U.rebuild_urls(U.build_url_catalog(I.page_candidates(spark, sf)))
    fields = jsonmodel.explode_json_fields(_event_models(spark, sf))
    both = jsonmodel.json_skeleton(fields, both=True)
    models = both.join(
        _event_models(spark, sf).select("project", "model_id", "canonical"), ["project", "model_id"]) \
        .withColumn("model_id", F.col("canonical"))
    report = sinks.build_report(urls=urls, models=models.select("project", "model_id", "skeleton", "populated"))
    return readers.read_report(sinks.report_lines(report))


QUERIES: dict[str, Query] = {
    "decompose_urls": q_decompose_urls,
    "url_query_pairs": q_url_query_pairs,
    "build_url_catalog": q_build_url_catalog,
    "rebuild_urls": q_rebuild_urls,
    "expand_routes": q_expand_routes,
    "join_base_urls": q_join_base_urls,
    "extract_literals": q_extract_literals,
    "collect_string_vars": q_collect_string_vars,
    "match_keywords": q_match_keywords,
    "files_without_snippets": q_files_without_snippets,
    "keep_maximal_spans": q_keep_maximal_spans,
    "enclosing_block": q_enclosing_block,
    "fold_appends": q_fold_appends,
    "fold_appends_through_calls": q_fold_appends_through_calls,
    "source_texts": q_source_texts,
    "source_urls": q_source_urls,
    "source_blocks": q_source_blocks,
    "string_declarations": q_string_declarations,
    "typed_call_rules": q_typed_call_rules,
    "corpus_schema": q_corpus_schema,
    "read_corpus": q_read_corpus,
    "list_files": q_list_files,
    "read_packages": q_read_packages,
    "write_snippets": q_write_snippets,
    "write_models": q_write_models,
    "fuzzy_fill_json": q_fuzzy_fill_json,
    "expand_concat": q_expand_concat,
    "resolve_local": q_resolve_local,
    "resolve_field": q_resolve_field,
    "resolve_param": q_resolve_param,
    "resolve_iterative": q_resolve_iterative,
    "resolve_values": q_resolve_values,
    "build_json_models": q_build_json_models,
    "explode_json_fields": q_explode_json_fields,
    "field_usage": q_field_usage,
    "json_skeleton": q_json_skeleton,
    "fold_json_puts": q_fold_json_puts,
    "fill_placeholders": q_fill_placeholders,
    "fuzzy_fill_queries": q_fuzzy_fill_queries,
    "request_plan": q_request_plan,
    "library_usage": q_library_usage,
    "models_per_library": q_models_per_library,
    "project_counters": q_project_counters,
    "project_summary": q_project_summary,
    "extract_calls": q_extract_calls,
    "extract_routes": q_extract_routes,
    "converter_libraries": q_converter_libraries,
    "serializer_models": q_serializer_models,
    "request_body_class_models": q_request_body_class_models,
    "extract_fields": q_extract_fields,
    "extract_imports": q_extract_imports,
    "attach_http_method": q_attach_http_method,
    "fold_reassigned_puts": q_fold_reassigned_puts,
    "match_call_rules": q_match_call_rules,
    "extract_dependencies": q_extract_dependencies,
    "match_available_version": q_match_available_version,
    "urls_from_candidates": q_urls_from_candidates,
    "assemble_urls": q_assemble_urls,
    "fold_builder_steps": q_fold_builder_steps,
    "stream_url_catalog": q_stream_url_catalog,
    "resolve_return": q_resolve_return,
    "resolve_field_access": q_resolve_field_access,
    "alias_through_params": q_alias_through_params,
    "nest_json_values": q_nest_json_values,
    "schema_from_fields": q_schema_from_fields,
    "request_body_models": q_request_body_models,
    "read_report": q_read_report,
}
