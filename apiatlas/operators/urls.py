"""URL jobs U1-U9: take candidate strings apart and merge them into an API catalog.

Input of the catalog jobs is a *candidate* table
``(project, path, line, library, text, ord[, verb])``; ``ord`` is the explicit
order key that replaces source traversal order ("first"/"last" = min/max ord).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiatlas.functions import encoding as enc
from apiatlas.functions import urlparts as up
from apiatlas.session import write_table

QUERY_T = "array<struct<key:string,value:string>>"


# --------------------------------------------------------------------------- U1
def decompose_urls(df: DataFrame, text_col: str = "text", keep_invalid: bool = False) -> DataFrame:
    """Add ``is_url scheme authority base_url endpoint queries fragments``.

    ``endpoint`` is NULL when the URL carries no endpoint (base only, or a
    remainder made of '?'/'#' alone); an empty string is a real, empty endpoint.
    Rows that are not URLs drop unless ``keep_invalid``. One projection, no shuffle.
    """
    t = F.col(text_col)
    scheme = up.url_scheme(t)
    out = df.withColumn("scheme", scheme) \
        .withColumn("_rest", up.url_rest(t, F.col("scheme"))) \
        .withColumn("authority", up.url_authority(F.col("_rest"))) \
        .withColumn("is_url", F.col("scheme").isNotNull() & (F.length("authority") > 0)) \
        .withColumn("_rem", up.url_remainder(F.col("_rest"), F.col("authority"))) \
        .withColumn("_head", up.endpoint_head(F.col("_rem"))) \
        .withColumn("_tail", F.col("_rem").substr(F.length("_head") + 1, F.lit(1 << 30)))
    has_ep = F.col("is_url") & F.col("_rem").rlike("[^?#]")
    out = out.withColumn("base_url", F.when(F.col("is_url"), F.concat("scheme", "authority"))) \
        .withColumn("endpoint", F.when(has_ep, up.strip_one_slash(F.col("_head")))) \
        .withColumn("queries", F.when(has_ep, up.query_entries(F.col("_tail")))
                    .otherwise(F.array().cast(QUERY_T))) \
        .withColumn("fragments", F.when(has_ep, up.fragment_list(F.col("_tail")))
                    .otherwise(F.array().cast("array<string>"))) \
        .drop("_rest", "_rem", "_head", "_tail")
    if not keep_invalid:
        out = out.filter("is_url")
    return out


def query_string(queries: Column) -> Column:
    """array<struct<key,value>> -> ``k=v&k2=v2`` sorted by key (NULL when empty)."""
    s = F.array_join(F.transform(F.array_sort(queries), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
    return F.when(F.size(queries) > 0, s)


def joined(arr: Column, sep: str = ",") -> Column:
    return F.when(F.size(arr) > 0, F.array_join(F.array_sort(arr), sep))


# -------------------------------------------------------------------------- U1q
def url_query_pairs(candidates: DataFrame) -> DataFrame:
    """U1q+U2: one row per (project, base_url, endpoint, key); first value by ``ord`` wins.

    Partial aggregation (min_by) runs before the shuffle, so a hot key costs one
    row per map task, not one row per occurrence.
    """
    d = decompose_urls(candidates).filter(F.col("endpoint").isNotNull())
    q = d.select("project", "base_url", "endpoint", "ord", F.explode("queries").alias("q"))
    return q.groupBy("project", "base_url", "endpoint", F.col("q.key").alias("key")) \
        .agg(F.min_by("q.value", "ord").alias("value"))


# --------------------------------------------------------------------------- U2
PARTIAL_KEYS = ["project", "base_url", "endpoint", "key"]


def catalog_partials(candidates: DataFrame) -> DataFrame:
    """U2, step 1: one row per (project, base_url, endpoint, query key).

    Rows without queries keep key NULL, rows without endpoint keep endpoint
    NULL. Every column is a decomposable aggregate (min/max/min_by/max_by/set
    union), so partials of different batches merge with ``merge_partials``.
    """
    verb = F.col("verb") if "verb" in candidates.columns else F.lit(None).cast("string")
    d = decompose_urls(candidates).select(
        "project", "base_url", "scheme", "authority", "library", "path", "ord", "endpoint",
        "queries", "fragments", verb.alias("verb"))
    ep_ord = F.when(F.col("endpoint").isNotNull(), F.col("ord"))
    return d.select("*", F.explode_outer("queries").alias("q")) \
        .groupBy("project", "base_url", "endpoint", F.col("q.key").alias("key")) \
        .agg(F.min("ord").alias("first_ord"),
             F.min_by("path", "ord").alias("first_path"),
             F.min_by("library", "ord").alias("first_library"),
             F.max(ep_ord).alias("last_ep_ord"),
             F.max_by("library", ep_ord).alias("last_ep_library"),
             F.min_by("q.value", "ord").alias("value"),
             F.min_by("fragments", "ord").alias("fragments"),
             F.array_sort(F.collect_set("verb")).alias("verbs"),
             F.first("scheme").alias("scheme"), F.first("authority").alias("authority"))


def merge_partials(partials: DataFrame) -> DataFrame:
    """Combine partial rows with the same key (e.g. old state + a new batch)."""
    return partials.groupBy(*PARTIAL_KEYS).agg(
        F.min("first_ord").alias("first_ord"),
        F.min_by("first_path", "first_ord").alias("first_path"),
        F.min_by("first_library", "first_ord").alias("first_library"),
        F.max("last_ep_ord").alias("last_ep_ord"),
        F.max_by("last_ep_library", "last_ep_ord").alias("last_ep_library"),
        F.min_by("value", "first_ord").alias("value"),
        F.min_by("fragments", "first_ord").alias("fragments"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("verbs")))).alias("verbs"),
        F.first("scheme").alias("scheme"), F.first("authority").alias("authority"))


def finalize_catalog(partials: DataFrame) -> DataFrame:
    """U2, step 2: partial rows -> one row per (project, base_url, endpoint).

    The partials (one row per distinct endpoint and key) are written once; endpoints are
    aggregated by their own key, bases by theirs with map-side partial aggregation, and the
    few base rows are joined back. No task gathers a base's endpoints: the join's exchanges
    are Spark's own, so a base with a third of all endpoints is split at run time.
    """
    partials = write_table(partials)
    has = F.col("endpoint").isNotNull()
    ends = partials.groupBy("project", "base_url", "endpoint").agg(
        F.min_by("fragments", "first_ord").alias("fragments"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("verbs")))).alias("http_methods"),
        F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(),
                                           F.struct("key", "value")))).alias("queries"),
        F.first("scheme").alias("scheme"), F.first("authority").alias("authority"))
    bases = partials.groupBy("project", "base_url").agg(
        F.min_by("first_path", "first_ord").alias("first_path"),
        F.coalesce(F.max_by("last_ep_library", "last_ep_ord"), F.min_by("first_library", "first_ord")).alias("library"),
        F.max(has.cast("int")).alias("_has_ep"))
    return write_table(ends).join(bases, ["project", "base_url"]).filter(has | (F.col("_has_ep") == 0)).select(
        "project", "base_url", "scheme", "authority", "library", "first_path", "endpoint",
        F.when(has, F.col("queries")).otherwise(F.array().cast(QUERY_T)).alias("queries"),
        F.when(has, F.col("fragments")).otherwise(F.array().cast("array<string>")).alias("fragments"),
        F.when(has, F.col("http_methods")).otherwise(F.array().cast("array<string>")).alias("http_methods"))


def build_url_catalog(candidates: DataFrame) -> DataFrame:
    """Merge decomposed URLs into one row per (project, base_url, endpoint).

    Rules (explicit ``ord`` replaces traversal order):
    * base row: ``first_path`` = path of the first occurrence; ``library`` = the
      last writer among rows that carry an endpoint, else the first row's;
    * endpoint row: queries = first value per key; ``http_methods`` = union;
      ``fragments`` = those of the endpoint's first occurrence;
    * a base seen without any endpoint gives one row with ``endpoint`` NULL.

    Plan: one scan + projection, a key-level aggregation with map-side
    partial aggregation (a hot base costs one row per distinct endpoint/key
    per map task, never one per occurrence), then ``finalize_catalog``.
    """
    return finalize_catalog(catalog_partials(candidates))


def flatten_catalog(catalog: DataFrame) -> DataFrame:
    """Catalog with scalar columns only (queries/fragments/methods as text)."""
    return catalog.select(
        "project", "base_url", "library", "first_path", "endpoint",
        query_string(F.col("queries")).alias("query_string"),
        joined(F.col("fragments")).alias("fragments"),
        joined(F.col("http_methods")).alias("http_methods"))


# --------------------------------------------------------------------------- U3
def urls_from_candidates(exprs: DataFrame, key_cols=("project", "expr_id")) -> DataFrame:
    """Every alternative string of an expression goes through U1; reports per
    expression whether any alternative was a URL. Input has ``alternatives ARRAY<STRING>``."""
    keys = list(key_cols)
    alts = exprs.select(*keys, F.explode_outer("alternatives").alias("text"))
    d = decompose_urls(alts, keep_invalid=True)
    # an expression without alternatives keeps its row: no URL
    return d.groupBy(*keys).agg(F.coalesce(F.bool_or("is_url"), F.lit(False)).alias("any_url"),
                                F.count_if(F.col("is_url")).alias("n_urls"))


# --------------------------------------------------------------------------- U4
def assemble_urls(parts: DataFrame) -> DataFrame:
    """U4: URL constructor arguments -> candidate strings (cartesian over alternatives).

    Input ``(project, expr_id, n_args, arg_pos, alternatives ARRAY<STRING>)``; 1 arg = spec,
    2 = context+spec, 3 = protocol://host+file, 4 = protocol://host:port+file.
    A missing or empty argument drops the expression. Output ``(project, expr_id, text)``.
    """
    grouped = parts.groupBy("project", "expr_id").agg(
        F.first("n_args").alias("n_args"),
        F.count("*").alias("n_seen"),
        F.array_sort(F.collect_list(F.struct("arg_pos", "alternatives"))).alias("args"))
    ok = grouped.filter((F.col("n_seen") == F.col("n_args")) & F.col("n_args").between(1, 4)
                        & F.forall("args", lambda a: F.size(a["alternatives"]) > 0))
    sep = {1: [], 2: [""], 3: ["://", ""], 4: ["://", ":", ""]}

    def times(acc: Column, i: int, s: str) -> Column:
        nxt = F.col("args")[i]["alternatives"]
        return F.flatten(F.transform(acc, lambda p: F.transform(nxt, lambda x: F.concat(p, F.lit(s), x))))

    def product_with(n: int) -> Column:
        acc = F.col("args")[0]["alternatives"]
        for i in range(1, n):
            acc = times(acc, i, sep[n][i - 1])
        return acc

    texts = reduce(lambda c, n: c.when(F.col("n_args") == n, product_with(n)),
                   [2, 3, 4], F.when(F.col("n_args") == 1, product_with(1)))
    return ok.select("project", "expr_id", F.explode(texts).alias("text"))


# --------------------------------------------------------------------------- U5
# Parameter types a route may carry; primitives map to their boxed name.
ROUTE_TYPES = {"String": "String", "Double": "Double", "Float": "Float", "Integer": "Integer",
               "Boolean": "Boolean", "int": "Integer", "long": "Long", "double": "Double",
               "float": "Float", "boolean": "Boolean", "char": "Character", "byte": "Byte",
               "short": "Short"}
ROUTE_VERBS = ["GET", "POST", "PATCH", "DELETE", "PUT"]


def _route_type(t: Column) -> Column:
    m = F.create_map(*[x for kv in ROUTE_TYPES.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.try_element_at(m, t)


def expand_routes(routes: DataFrame) -> DataFrame:
    """Route template -> URL text with typed placeholders.

    ``{name}`` of a Path parameter -> ``<Type>``; a Query parameter appends
    ``&name=<Type>``; parameters of other types are skipped; then the first '&'
    becomes '?' when no '?' precedes it. Only GET/POST/PATCH/DELETE/PUT routes.
    """
    params = F.array_sort(F.coalesce(F.col("params"), F.array().cast(
        "array<struct<ann:string,arg:string,type:string,pos:int>>")),
        lambda a, b: (a["pos"] - b["pos"]).cast("int"))

    def step(acc, p):
        typ = _route_type(p["type"])
        tag = F.concat(F.lit("<"), typ, F.lit(">"))
        return (F.when(typ.isNull(), acc)
                .when(p["ann"] == "Path", F.replace(acc, F.concat(F.lit("{"), p["arg"], F.lit("}")), tag))
                .when(p["ann"] == "Query", F.concat(acc, F.lit("&"), p["arg"], F.lit("="), tag))
                .otherwise(acc))

    url = F.aggregate(params, F.col("template"), step)
    return routes.filter(F.col("verb").isin(ROUTE_VERBS) & F.col("template").isNotNull()) \
        .withColumn("route_url", enc.amp_to_question_if_no_query(url))


# --------------------------------------------------------------------------- U6
ABSOLUTE_HTTP = r"(?i)^https?://[^/?#:]+"


def join_base_urls(expanded_routes: DataFrame, bases: DataFrame) -> DataFrame:
    """Every base URL of the route's client x route; an absolute route URL
    replaces the base; without a base the route URL stands alone. Output is a
    candidate table (library ``Retrofit``) ready for U2."""
    b = bases.select("project", "client", F.col("url").alias("base"))
    j = expanded_routes.join(b, ["project", "client"], "left")
    text = F.when(F.col("base").isNull() | F.col("route_url").rlike(ABSOLUTE_HTTP), F.col("route_url")) \
        .otherwise(F.concat("base", "route_url"))
    return j.select("project", "path", F.lit("Retrofit").alias("library"), text.alias("text"),
                    "verb", "ord", "iface", "method", "base")


# --------------------------------------------------------------------------- U7
def _step_pieces(step: Column, alts: Column, alts2: Column) -> Column:
    """Alternatives of one builder call -> list of URL pieces (NULL = unknown call)."""
    is_typed = lambda v: v.isin(enc.TYPE_PLACEHOLDERS)
    pair = lambda enc_fn: F.flatten(F.transform(alts, lambda k: F.transform(
        alts2, lambda v: F.concat(F.lit("&"), enc_fn(k, v)))))
    return (F.when(step == "scheme", F.transform(alts, lambda x: F.concat(x, F.lit("://"))))
            .when(step.isin("host", "parse"), alts)
            .when(step == "port", F.transform(alts, lambda x: F.concat(F.lit(":"), x)))
            .when(step == "addPathSegment",
                  F.transform(alts, lambda x: F.concat(F.lit("/"), enc.encode_path_segment(x))))
            .when(step == "addPathSegments",
                  F.transform(alts, lambda x: F.concat(F.lit("/"), enc.encode_path_segments(x))))
            .when(step.isin("addEncodedPathSegment", "addEncodedPathSegments"),
                  F.transform(alts, lambda x: F.concat(F.lit("/"), x)))
            .when(step == "fragment", F.transform(alts, lambda x: F.concat(F.lit("#"), enc.encode_fragment(x))))
            .when(step == "encodedFragment", F.transform(alts, lambda x: F.concat(F.lit("#"), x)))
            .when(step == "addQueryParameter", pair(lambda k, v: F.when(
                is_typed(v), F.concat(k, F.lit("="), v)).otherwise(
                F.concat(enc.encode_query_component(k), F.lit("="), enc.encode_query_component(v)))))
            .when(step == "addEncodedQueryParameter", pair(lambda k, v: F.concat(k, F.lit("="), v))))


def fold_builder_steps(steps: DataFrame, max_alternatives: int | None = None) -> DataFrame:
    """Ordered URL-builder calls per builder -> URL candidates.

    ``steps(project, path, builder, pos, step, alts ARRAY<STRING>[, alts2][, is_init])``;
    each call maps its alternatives to pieces, pieces multiply in call order,
    unknown calls are skipped, then the first '&' becomes '?'. A declared
    builder (steps flagged ``is_init`` come from its initialiser) with no later
    call yields nothing.
    """
    if "is_init" in steps.columns:
        used = steps.filter(~F.coalesce(F.col("is_init"), F.lit(False))).select("project", "path", "builder").distinct()
        steps = steps.join(used, ["project", "path", "builder"], "left_semi")
    alts2 = F.col("alts2") if "alts2" in steps.columns else F.array().cast("array<string>")
    pieces = steps.select("project", "path", "builder", "pos",
                          _step_pieces(F.col("step"), F.col("alts"), alts2).alias("pieces")) \
        .filter(F.col("pieces").isNotNull() & (F.size("pieces") > 0))
    folded = product_fold(pieces, ["project", "path", "builder"], "pos", "pieces", max_alternatives)
    return folded.select("project", "path", "builder",
                         enc.first_amp_to_question(F.col("value")).alias("text"))


def product_fold(df: DataFrame, keys: list[str], pos_col: str, alts_col: str,
                 max_alternatives: int | None = None, sep: str = "",
                 num_partitions: int | None = None) -> DataFrame:
    """Ordered cartesian concatenation of per-step alternatives, one row per result.

    Two levels, so a key with a huge number of steps is not gathered raw into one task: the steps
    are range-partitioned on (keys, pos), and each partition joins its runs of steps with one
    alternative into one factor; the factors of a key are then put together in partition
    order. They stay factors: a key's combinations are numbered, dealt to tasks by their numbers
    and made there (``product.choices``), so a key with millions of results is not one row.
    ``max_alternatives`` keeps each key's first results. Equal positions are ordered by their
    alternatives, so ties are deterministic. Default: no bound, whole results (the reference
    stops growing above 100).
    """
    from apiatlas.operators import product
    from apiatlas.session import materialize
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = df.select(*keys, F.col(pos_col).alias("_p"), F.col(alts_col).alias("_a"))
    ranged = materialize(steps.repartitionByRange(n, *[F.col(k) for k in keys], F.col("_p"), F.col("_a"))
                         .withColumn("_pid", F.spark_partition_id()))
    part = ranged.groupBy(*keys, "_pid").agg(
        F.array_sort(F.collect_list(F.struct("_p", "_a"))).alias("_s")) \
        .select(*keys, "_pid", product.merged_runs(F.transform("_s", lambda x: x["_a"]), sep).alias("_part"))
    whole = part.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pid", "_part"))).alias("_s")) \
        .select(*keys, product.merged_runs(F.flatten(F.transform("_s", lambda x: x["_part"])), sep).alias("_factors"))
    return product.choices(whole, "_factors", max_alternatives).select(*keys, F.array_join("choice", sep).alias("value"))


# --------------------------------------------------------------------------- U8
def attach_http_method(requests: DataFrame, builder_urls: DataFrame) -> DataFrame:
    """U8: request chains -> (project, url_var, verb) for the builder URLs.

    ``requests(project, request, pos, call, arg)`` lists the calls of one
    request chain in source order; ``url(var)`` names the URL variable, a later
    post/patch/put/delete gives it a verb, the verb nearest after ``url`` wins;
    verbs before ``url`` are lost. The verb is joined to the builder URLs
    ``(project, builder, text)`` on the variable name.
    """
    url_calls = requests.filter(F.col("call") == "url").select(
        "project", "request", F.col("pos").alias("url_pos"), F.col("arg").alias("url_var"))
    verbs = requests.filter(F.col("call").isin("post", "patch", "put", "delete")).select(
        "project", "request", F.col("pos").alias("verb_pos"), F.upper("call").alias("verb"))
    after = F.when(F.col("verb_pos") > F.col("url_pos"), F.col("verb_pos"))
    # min_by leaves out rows without an order: a chain whose verbs all precede url keeps its URL
    chosen = url_calls.join(verbs, ["project", "request"], "left") \
        .groupBy("project", "request", "url_var").agg(F.min_by("verb", after).alias("verb"))
    return builder_urls.join(chosen.withColumnRenamed("url_var", "builder"), ["project", "builder"], "inner") \
        .select("project", "builder", "request", "text", "verb")


# --------------------------------------------------------------------------- U9
def rebuild_urls(catalog: DataFrame, filled_queries: DataFrame | None = None) -> DataFrame:
    """Catalog endpoint rows -> full URL text, raw and sample-filled.

    ``base/endpoint?k=v&...#fragment`` with keys sorted and the last (greatest)
    fragment; ``populated`` fills placeholders (G1) in path, keys, values and
    fragment, or takes fuzzy-filled values from ``filled_queries``
    ``(project, base_url, endpoint, key, value)`` when given (G2).
    """
    eps = catalog.filter(F.col("endpoint").isNotNull())
    frag = F.try_element_at(F.array_sort("fragments"), F.lit(-1))

    def render(path, queries, fragment):
        q = F.array_join(F.transform(F.array_sort(queries),
                                     lambda e: F.concat(e["key"], F.lit("="), e["value"])), "&")
        return F.concat(F.col("base_url"), F.lit("/"), path,
                        F.when(F.size(queries) > 0, F.concat(F.lit("?"), q)).otherwise(F.lit("")),
                        F.when(fragment.isNotNull(), F.concat(F.lit("#"), fragment)).otherwise(F.lit("")))

    if filled_queries is not None:
        fq = filled_queries.groupBy("project", "base_url", "endpoint").agg(
            F.collect_list(F.struct("key", "value")).alias("_filled"))
        eps = eps.join(fq, ["project", "base_url", "endpoint"], "left")
        pop_q = F.coalesce(F.col("_filled"), F.col("queries"))
    else:
        pop_q = F.col("queries")
    pop_q = F.transform(pop_q, lambda e: F.struct(enc.fill_placeholders(e["key"]).alias("key"),
                                                 enc.fill_placeholders(e["value"]).alias("value")))
    return eps.select("project", "base_url", "endpoint",
                      render(F.col("endpoint"), F.col("queries"), frag).alias("raw_url"),
                      render(enc.fill_placeholders(F.col("endpoint")), pop_q,
                             enc.fill_placeholders(frag)).alias("populated_url"))
