"""JSON jobs J1-J4 (+J6 schema from class fields): build, explode, render JSON models.

Documents are Spark VARIANT values; the tree walk explodes one level per round,
and rendering is bottom-up aggregation, one level per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apiatlas.functions import encoding as enc
from apiatlas.session import write_table

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1
# String placeholders that stand for a typed unknown, and their tag.
PLACEHOLDER_TAG = {"<STRING>": "STRING", "<DOUBLE>": "NUMBER_DOUBLE", "<FLOAT>": "NUMBER_DOUBLE",
                   "<INTEGER>": "NUMBER_INT", "<BOOLEAN>": "BOOLEAN", "<NULL>": "NULL"}


def json_string(col) -> F.Column:
    """A string as a quoted, escaped JSON string literal."""
    quoted = F.to_json(F.array(col))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def is_json_candidate(text) -> F.Column:
    """F3 shape test: starts with '{', ends with '}', at least 4 characters."""
    return text.startswith("{") & text.endswith("}") & (F.length(text) >= 4)


# --------------------------------------------------------------------------- J1
LENIENT_JSON = {"allowUnquotedFieldNames": "true", "allowSingleQuotes": "true"}


def parse_json_text(text, lenient: bool = False) -> F.Column:
    """Text -> VARIANT (NULL when invalid). ``lenient`` also accepts unquoted
    field names and single-quoted strings, as hand-written JSON in code often has."""
    return F.from_json(text, "variant", LENIENT_JSON) if lenient else F.try_parse_json(text)


def build_json_models(candidates: DataFrame, text_col: str = "text", unescape: bool = True,
                      lenient: bool = False) -> DataFrame:
    """Strings -> valid JSON models, de-duplicated per project.

    A candidate must pass F3 and parse (``try_parse_json``, or the lenient
    reader with ``lenient=True``); duplicates are
    found on the canonical form (``to_json`` of the VARIANT: compact, keys
    sorted), the first occurrence by ``ord`` is kept. Output
    ``(project, model_id, canonical, path, library, first_ord, n_occurrences)``.
    """
    t = enc.unescape_java(F.col(text_col)) if unescape else F.col(text_col)
    c = candidates.select("project", "path", "library", "ord", t.alias("_t")) \
        .filter(is_json_candidate(F.col("_t"))) \
        .withColumn("_v", parse_json_text(F.col("_t"), lenient)) \
        .filter(F.col("_v").isNotNull()) \
        .select("project", "path", "library", "ord", F.to_json("_v").alias("canonical"))
    g = c.groupBy("project", "canonical").agg(
        F.min("ord").alias("first_ord"), F.min_by("path", "ord").alias("path"),
        F.min_by("library", "ord").alias("library"), F.count("*").alias("n_occurrences"))
    return g.withColumn("model_id", F.substring(F.sha2(F.concat_ws("\u0001", "project", "canonical"), 256), 1, 16))


# --------------------------------------------------------------------------- J2
PLAIN_KEY = "^[A-Za-z_][A-Za-z0-9_]*$"


def child_path(parent, key, idx) -> F.Column:
    """A node's path: ``parent.key`` or ``parent[idx]``. Keys that are no plain name are
    quoted and escaped, so two nodes of a document never share a path."""
    escaped = F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    step = F.when(F.rlike(key, F.lit(PLAIN_KEY)), key).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))
    return F.when(key.isNull(), F.concat(parent, F.lit("["), idx.cast("string"), F.lit("]"))) \
        .otherwise(F.concat(parent, F.lit("."), step))


def explode_json_fields(models: DataFrame, json_col: str = "canonical", max_depth: int | None = None) -> DataFrame:
    """Walk every model into typed nodes.

    Output ``(project, model_id, path, parent_path, key, idx, depth, jtype, value)``;
    ``key`` is NULL for array elements (``idx`` is their position). Type tags:
    OBJECT, ARRAY, STRING, BOOLEAN, NULL, NUMBER_INT (integral and within
    32-bit range), NUMBER_DOUBLE (anything else numeric); placeholder strings
    such as ``"<INTEGER>"`` become typed unknowns (value NULL).

    One round per level over the containers of the level above (``variant_explode`` of their
    own rows, no shuffle), each level written once; the rounds end with the deepest document.
    ``max_depth`` (default: none) stops the walk earlier on request.
    """
    from apiatlas.session import RoundTable
    levels = RoundTable(models.sparkSession, "depth")
    now = levels.add(models.select(
        "project", "model_id", F.lit("$").alias("path"), F.lit(None).cast("string").alias("parent_path"),
        F.lit(None).cast("string").alias("key"), F.lit(None).cast("int").alias("idx"),
        F.try_parse_json(json_col).alias("v")).filter("v IS NOT NULL"))
    while max_depth is None or levels.rounds <= max_depth:
        kind = F.schema_of_variant("v")
        inner = now.filter(kind.startswith("OBJECT<") & (kind != "OBJECT<>") | kind.startswith("ARRAY<"))
        if inner.isEmpty():
            break
        kids = inner.select("project", "model_id", F.col("path").alias("parent_path"), "v") \
            .lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("v").outer())) \
            .select("project", "model_id", "parent_path", "pos", F.col("key"), F.col("value").alias("v"))
        now = levels.add(kids.select(
            "project", "model_id", child_path(F.col("parent_path"), F.col("key"), F.col("pos")).alias("path"), "parent_path", "key",
            F.when(F.col("key").isNull(), F.col("pos")).alias("idx"), "v"))
    nodes = levels.all()
    s = F.schema_of_variant("v")
    as_str = F.try_variant_get("v", "$", "string")
    as_dbl = F.try_variant_get("v", "$", "double")
    ph = F.create_map(*[x for kv in PLACEHOLDER_TAG.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    is_num = s.startswith("DECIMAL") | s.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")
    integral = (as_dbl == F.floor(as_dbl)) & as_dbl.between(INT_MIN, INT_MAX)
    jtype = (F.when(s.startswith("OBJECT"), "OBJECT").when(s.startswith("ARRAY"), "ARRAY")
             .when(s == "VOID", "NULL").when(s == "BOOLEAN", "BOOLEAN")
             .when(is_num & integral, "NUMBER_INT").when(is_num, "NUMBER_DOUBLE")
             .when(s == "STRING", F.coalesce(F.try_element_at(ph, as_str), F.lit("STRING")))
             .otherwise("STRING"))
    placeholder = (s == "STRING") & F.try_element_at(ph, as_str).isNotNull()
    value = F.when(s.startswith("OBJECT") | s.startswith("ARRAY") | (s == "VOID") | placeholder, F.lit(None)) \
        .when(s == "STRING", as_str).otherwise(F.to_json("v"))
    return nodes.select("project", "model_id", "path", "parent_path", "key", "idx", "depth",
                        jtype.alias("jtype"), value.cast("string").alias("value"))


# --------------------------------------------------------------------------- J3
def json_skeleton(fields: DataFrame, with_values: bool = False, both: bool = False) -> DataFrame:
    """Render each model from its nodes, bottom-up, one depth level per round
    (the nodes are first written once, partitioned by depth).

    Without values leaves render as their tag (``"<NUMBER_INT>"``; NULL stays
    ``null``); with values they render as JSON literals (strings quoted through
    ``to_json`` so they stay valid JSON), unknown leaves as their tag. Object
    keys come in sorted order, array elements in source order. Output
    ``(project, model_id, skeleton)``; with ``both`` the two renderings come
    from one pass as ``skeleton`` and ``populated``.
    """
    from apiatlas.session import write_table
    # the node table is written once, laid out by depth: every level below reads
    # only its own partition instead of recomputing the (recursive) node walk
    fields = write_table(fields.select("project", "model_id", "path", "parent_path", "key", "idx", "depth",
                                       "jtype", "value"), ["depth"])
    max_depth = fields.agg(F.max("depth")).first()[0] or 0
    tag = F.when(F.col("jtype") == "NULL", F.lit("null")).otherwise(
        F.concat(F.lit('"<'), F.col("jtype"), F.lit('>"')))
    lit = F.when(F.col("jtype") == "STRING", json_string(F.col("value"))).otherwise(F.col("value"))
    valued = F.when(F.col("value").isNotNull(), lit).otherwise(tag)
    leaf = F.when(~F.col("jtype").isin("OBJECT", "ARRAY"), tag)
    leafv = F.when(~F.col("jtype").isin("OBJECT", "ARRAY"), valued)
    base = fields.withColumn("r", leafv if (with_values and not both) else leaf).withColumn("rv", leafv)

    def container(kids_col: str, field: str):
        kids = F.coalesce(F.col(kids_col), F.array().cast("array<struct<i:int,k:string,r:string,rv:string>>"))
        obj = F.concat(F.lit("{"), F.array_join(F.transform(
            kids, lambda e: F.concat(json_string(e["k"]), F.lit(":"), e[field])), ","), F.lit("}"))
        arr = F.concat(F.lit("["), F.array_join(F.transform(kids, lambda e: e[field]), ","), F.lit("]"))
        return F.when(F.col("jtype") == "OBJECT", obj).when(F.col("jtype") == "ARRAY", arr)

    rendered = None
    for d in range(max_depth, -1, -1):
        level = base.filter(F.col("depth") == d)
        if rendered is not None:
            kids = rendered.groupBy("project", "model_id", F.col("parent_path").alias("path")).agg(
                F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("idx"), F.lit(0)).alias("i"),
                                                     F.col("key").alias("k"), F.col("r").alias("r"),
                                                     F.col("rv").alias("rv")))).alias("kids"))
            level = level.join(kids, ["project", "model_id", "path"], "left")
        else:
            level = level.withColumn("kids", F.lit(None).cast("array<struct<i:int,k:string,r:string,rv:string>>"))
        level = level.withColumn("r", F.coalesce(container("kids", "r"), F.col("r"))) \
            .withColumn("rv", F.coalesce(container("kids", "rv"), F.col("rv")))
        rendered = level.select("project", "model_id", "path", "parent_path", "key", "idx", "r", "rv")
    top = rendered.filter(F.col("path") == "$")
    if both:
        return top.select("project", "model_id", F.col("r").alias("skeleton"), F.col("rv").alias("populated"))
    return top.select("project", "model_id", F.col("r").alias("skeleton"))


def corpus_schema(models: DataFrame, text_col: str = "canonical") -> DataFrame:
    """J3 at corpus level: one schema for all JSON models of a project -> ``(project, schema)``.

    The schemas of documents merge as they meet (``schema_of_variant_agg``, partial aggregates first):
    a key of any document is a key, other types of one key become ``VARIANT``. Texts that are no JSON
    have no part in it."""
    doc = F.try_parse_json(F.col(text_col))
    return models.filter(doc.isNotNull()).groupBy("project").agg(F.schema_of_variant_agg(doc).alias("schema"))


# --------------------------------------------------------------------------- J4
def _render_put_value(vt, v) -> F.Column:
    return (F.when(v.isNull() | (v == "null"), F.lit("null"))
            .when(vt.isin("int", "integer", "long"), F.coalesce(v.try_cast("bigint").cast("string"), json_string(v)))
            .when(vt.isin("number", "double", "float"), F.coalesce(v.try_cast("double").cast("string"), json_string(v)))
            .when(vt == "boolean", F.lower(v))
            .when(vt == "json", v)
            .otherwise(json_string(v)))


def fold_json_puts(puts: DataFrame) -> DataFrame:
    """J4/J4s: ordered ``put`` events per JSON object -> documents.

    ``puts(project, object, pos, key, value, value_type[, is_new])``.
    ``put(key, value)`` builds an object, the last value per key winning
    (``max_by`` on the order key, partial aggregation first); ``put(value)``
    (key NULL) appends to an array in ``pos`` order. ``null`` text becomes JSON
    null and values are typed by ``value_type`` (int / number / boolean /
    string / json). With ``is_new``, a re-assignment starts a new document: each put
    belongs to the nearest ``is_new`` put at or before it. The puts are range-partitioned on
    (object, pos); each partition takes its own running marker, and the last marker
    of an object's earlier partitions is carried in, so no object is one task.
    Output ``(project, object, doc_no, n_keys, doc)``; ``doc_no`` is the
    position of the document's first put (0 before any re-assignment).
    """
    if "is_new" in puts.columns:
        from apiatlas.session import materialize, shuffle_partitions
        own = ["project", "object"]
        ranged = materialize(puts.repartitionByRange(shuffle_partitions(puts.sparkSession), *own, "pos")
                             .withColumn("_pid", F.spark_partition_id()))
        marker = F.max(F.when(F.col("is_new"), F.col("pos")))
        last = ranged.groupBy("_pid", *own).agg(marker.alias("_last"))
        carry = last.withColumn("_carry", F.max("_last").over(
            Window.partitionBy(*own).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
        here = marker.over(Window.partitionBy("_pid", *own).orderBy("pos"))
        puts = ranged.withColumn("_here", here).join(carry, ["_pid", *own]) \
            .withColumn("doc_no", F.coalesce(F.coalesce("_here", "_carry").cast("string"), F.lit("0"))).drop("_pid", "_here", "_carry")
    else:
        puts = puts.withColumn("doc_no", F.lit("0"))
    keys = ["project", "object", "doc_no"]
    # one pass: the last value per key, every array element on its own (key NULL, its position)
    step = puts.withColumn("_epos", F.when(F.col("key").isNull(), F.col("pos")))
    last = step.groupBy(*keys, "key", "_epos").agg(F.max_by(F.struct("value", "value_type"), "pos").alias("lv")) \
        .select(*keys, "key", "_epos", _render_put_value(F.col("lv.value_type"), F.col("lv.value")).alias("rv"))
    docs = last.groupBy(*keys).agg(
        F.count_if(F.col("key").isNotNull()).alias("n_keys"),
        F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct(
            "key", F.concat(json_string(F.col("key")), F.lit(":"), F.col("rv")).alias("kv"))))).alias("_kv"),
        F.array_sort(F.collect_list(F.when(F.col("key").isNull(), F.struct("_epos", "rv")))).alias("_ev"))
    # an object that got both kinds of put keeps its keyed form
    doc = F.when(F.col("n_keys") > 0, F.concat(F.lit("{"), F.array_join(F.transform("_kv", lambda e: e["kv"]), ","),
                                                F.lit("}"))) \
        .otherwise(F.concat(F.lit("["), F.array_join(F.transform("_ev", lambda e: e["rv"]), ","), F.lit("]")))
    return docs.select("project", "object", "doc_no", F.col("n_keys").cast("long").alias("n_keys"), doc.alias("doc"))


def fold_json_events(events: DataFrame) -> DataFrame:
    """J4 and J4s with alternatives: the documents that an object's events can build.

    ``events(project, object, pos, kind, key, alts ARRAY<STRUCT<value,value_type>>)`` in order of ``pos``:

    * ``put``: ``put(key, value)``, or ``put(value)`` of an array (``key`` NULL);
    * ``seed``: the object is created from one of the JSON texts ``alts``;
    * ``new``: it is created empty, or assigned anew.

    A seed or new object starts a document; what stood before stays a document of its own. Within a
    document the last put of a key wins over earlier ones and over the seed's key; array elements follow
    the seed's in order. Each key's alternatives multiply (``product.choices``): one row for each
    combination, dealt to tasks by its number. A put without alternatives, whose value nobody
    knows, is left out, and so is a seed text that is no JSON of the object's kind. Output ``(project,
    object, doc_no, nth, doc)``, ``doc_no`` counting the object's documents from 0, keys sorted.

    The document numbers are a running count over (object, pos), range-partitioned with the
    counts of earlier partitions carried in, so no object is one task.
    """
    from apiatlas.operators import product
    from apiatlas.session import materialize, shuffle_partitions
    own = ["project", "object"]
    ranged = materialize(events.repartitionByRange(shuffle_partitions(events.sparkSession), *own, "pos").withColumn("_pid", F.spark_partition_id()))
    starts = F.col("kind").isin("seed", "new").cast("int")
    before = ranged.groupBy("_pid", *own).agg(F.sum(starts).alias("_n")).withColumn("_carry", F.sum("_n").over(
        Window.partitionBy(*own).orderBy("_pid")) - F.col("_n")).drop("_n")
    here = F.sum(starts).over(Window.partitionBy("_pid", *own).orderBy("pos"))
    numbered = ranged.withColumn("_here", here).join(before, ["_pid", *own]).withColumn("part", F.col("_here") + F.col("_carry")).drop("_pid", "_here", "_carry")

    keys = [*own, "part"]
    rendered = F.transform("alts", lambda a: F.struct(_render_put_value(a["value_type"], a["value"]).alias("text"), F.lit(None).cast("array<struct<key:string,value:string>>").alias("object"),
                                                      F.lit(None).cast("array<string>").alias("items")))
    # a seed's own keys or elements, as JSON texts
    parsed = F.transform("alts", lambda a: F.try_parse_json(enc.unescape_java(a["value"])))
    seeds = F.filter(F.transform(parsed, lambda v: F.struct(
        F.lit(None).cast("string").alias("text"),
        F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: F.struct(
            e["key"].alias("key"), F.to_json(e["value"]).alias("value"))).alias("object"),
        F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.to_json(x)).alias("items"))),
        lambda s: s["object"].isNotNull() | s["items"].isNotNull())
    puts = numbered.filter("kind = 'put' AND size(alts) > 0").withColumn("at", F.when(F.col("key").isNull(), F.struct("pos")))
    last = puts.groupBy(*keys, "key", "at").agg(F.max_by("alts", "pos").alias("alts")).select(*keys, "key", "at", rendered.alias("alts"))
    first = numbered.filter("kind = 'seed'").select(*keys, F.lit(None).cast("string").alias("key"), F.lit(None).cast(last.schema["at"].dataType).alias("at"),
                                                    seeds.alias("alts")).filter(F.size("alts") > 0)
    # a document that nothing was put into still is one
    every = numbered.select(*keys).distinct()
    factors = last.unionByName(first).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "key", "alts"))).alias("factors"))
    rows = every.join(factors, keys, "left").select(*keys, F.coalesce(F.transform("factors", lambda f: f["key"]), F.array().cast("array<string>")).alias("names"), F.coalesce(
        F.transform("factors", lambda f: f["alts"]), F.array().cast(f"array<{last.schema['alts'].dataType.simpleString()}>")).alias("factors"))
    # a part that starts with nothing and is followed by a start holds no document
    rows = rows.filter((F.col("part") > 0) | (F.size("factors") > 0))
    made = product.choices(rows, "factors")
    pairs = F.arrays_zip(F.col("names").alias("name"), F.col("choice").alias("c"))
    seed = F.try_element_at(F.filter("choice", lambda c: c["text"].isNull()), F.lit(1))
    put = F.transform(F.filter(pairs, lambda p: p["name"].isNotNull()), lambda p: F.struct(p["name"].alias("key"), p["c"]["text"].alias("value")))
    names = F.transform(put, lambda p: p["key"])
    kept = F.filter(seed["object"], lambda e: ~F.array_contains(names, e["key"]))
    entries = F.array_sort(F.concat(put, F.coalesce(kept, F.slice(put, 1, 0))))
    whole = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    items = F.concat(F.coalesce(seed["items"], F.array().cast("array<string>")), F.transform(
        F.filter(pairs, lambda p: p["name"].isNull() & p["c"]["text"].isNotNull()), lambda p: p["c"]["text"]))
    is_array = (F.size(put) == 0) & (seed["items"].isNotNull() | (F.size(items) > 0))
    doc = F.when(is_array, F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))).otherwise(whole)
    least = made.groupBy(*own).agg(F.min("part").alias("least"))
    return made.join(least, own).select("project", "object", (F.col("part") - F.col("least")).alias("doc_no"), "nth", doc.alias("doc"))


def fold_nested_events(events: DataFrame) -> DataFrame:
    """J5 over ``fold_json_events``: alternatives of ``value_type`` ``object`` name other objects, whose
    documents take their place, each an alternative.

    Objects are rendered innermost first: a round renders those whose referenced objects all have
    documents, and is written once. The rounds end when none becomes ready; objects on a
    reference cycle, or on a reference to an object without events, have no document.
    """
    from apiatlas.session import RoundTable
    own = ["project", "object"]
    events = write_table(events)
    alts = events.select(*own, "pos", "kind", "key", F.explode_outer("alts").alias("alt"))
    needs = write_table(alts.filter("alt.value_type = 'object'").select(*own, F.col("alt.value").alias("target")).distinct())
    objects, docs = events.select(*own).distinct(), RoundTable(events.sparkSession)
    while True:
        if docs.rounds:
            done = docs.all().select("project", F.col("object").alias("target"), F.col("doc").alias("inner")).distinct()
            waiting = needs.join(done, ["project", "target"], "left_anti")
            pending = objects.join(docs.all().select(*own).distinct(), own, "left_anti")
        else:
            done, waiting, pending = None, needs, objects
        ready = pending.join(waiting.select(*own).distinct(), own, "left_anti")
        rows = alts.join(ready, own, "left_semi").withColumn("target", F.when(F.col("alt.value_type") == "object", F.col("alt.value")))
        if done is not None:
            rows = rows.join(done, ["project", "target"], "left")
        else:
            rows = rows.withColumn("inner", F.lit(None).cast("string"))
        alt = F.when(F.col("target").isNotNull(), F.struct(F.col("inner").alias("value"), F.lit("json").alias("value_type"))).otherwise(F.col("alt"))
        whole = rows.groupBy(*own, "pos", "kind", "key").agg(F.array_sort(F.collect_set(alt)).alias("alts"))
        if docs.add(fold_json_events(whole)).isEmpty():
            return docs.all().drop(docs.name)


# --------------------------------------------------------------------------- J5
def nest_json_values(puts: DataFrame) -> DataFrame:
    """A put whose value is another built object (``value_type = 'object'``,
    ``value`` = that object's id) embeds the other object's document.

    Objects are rendered innermost first: a round renders the objects whose referenced
    objects have documents already (join + J4 aggregation) and counts the references that
    its documents settle; each round's documents are written once. The rounds end when no
    object becomes ready, however deep they nest; objects on a reference cycle, or on a
    reference to an object without puts, never render. Output ``(project, object, n_keys, doc)``.
    """
    from apiatlas.session import RoundTable, write_table
    key = ["project", "object"]
    p = puts.select("project", "object", "pos", "key", "value", "value_type")
    keyed = p.filter(F.col("key").isNotNull()).groupBy("project", "object", "key") \
        .agg(F.max_by(F.struct("pos", "value", "value_type"), "pos").alias("lv")) \
        .select("project", "object", "lv.pos", "key", "lv.value", "lv.value_type")
    # array elements (key NULL) all stay, in their order
    last = write_table(keyed.unionByName(p.filter(F.col("key").isNull())))
    refs = write_table(last.filter(F.col("value_type") == "object").select("project", "object", F.col("value").alias("target")).distinct())
    needs = refs.groupBy(*key).agg(F.count("*").alias("needs"))
    docs, settled = RoundTable(puts.sparkSession), RoundTable(puts.sparkSession)
    done = docs.add(fold_json_puts(last.join(needs, key, "left_anti")))
    while not done.isEmpty():
        # references that point to documents of the last round; an object whose count is full is ready
        new = settled.add(refs.join(done.select("project", F.col("object").alias("target")), ["project", "target"])
                          .groupBy(*key).agg(F.count("*").alias("k")))
        ready = new.select(*key).distinct().join(settled.all().groupBy(*key).agg(F.sum("k").alias("k")), key) \
            .join(needs, key).filter("k = needs").select(*key)
        rows = last.join(ready, key, "left_semi") \
            .join(docs.all().select("project", F.col("object").alias("value"), F.lit("object").alias("value_type"),
                                    F.col("doc").alias("_doc")), ["project", "value", "value_type"], "left")
        inner = F.col("value_type") == "object"
        rows = rows.withColumns({"value": F.when(inner, F.col("_doc")).otherwise(F.col("value")),
                                 "value_type": F.when(inner, F.lit("json")).otherwise(F.col("value_type"))}).drop("_doc")
        done = docs.add(fold_json_puts(rows))
    return docs.all().select(*key, "n_keys", "doc")


# --------------------------------------------------------------------------- J6
# Simple field types -> JSON type tag; other primitives box to a
# type the tag switch does not know and default to STRING.
SIMPLE_TAGS = {"String": "STRING", "java.lang.String": "STRING", "Double": "NUMBER_DOUBLE",
               "java.lang.Double": "NUMBER_DOUBLE", "double": "NUMBER_DOUBLE", "Float": "NUMBER_DOUBLE",
               "java.lang.Float": "NUMBER_DOUBLE", "float": "NUMBER_DOUBLE", "Integer": "NUMBER_INT",
               "java.lang.Integer": "NUMBER_INT", "int": "NUMBER_INT", "Boolean": "BOOLEAN",
               "java.lang.Boolean": "BOOLEAN", "boolean": "BOOLEAN", "long": "STRING", "short": "STRING",
               "byte": "STRING", "char": "STRING"}
# Collection types (simple names are accepted too).
COLLECTION_TYPES = [
    "java.util.List", "java.util.Vector", "java.util.AbstractSequentialList", "java.util.AbstractList",
    "java.util.AbstractQueue", "java.util.AbstractSet", "java.util.ArrayDeque", "java.util.ConcurrentLinkedDeque",
    "java.util.ArrayList", "java.util.LinkedList", "java.util.concurrent.ArrayBlockingQueue",
    "java.util.concurrent.ConcurrentLinkedQueue", "java.util.concurrent.DelayQueue",
    "java.util.concurrent.LinkedBlockingDeque", "java.util.concurrent.LinkedTransferQueue",
    "java.util.concurrent.PriorityBlockingQueue", "java.util.PriorityQueue", "java.util.concurrent.SynchronousQueue",
    "java.util.concurrent.BlockingDeque", "java.util.concurrent.TransferQueue", "java.util.concurrent.BlockingQueue",
    "java.util.Deque", "java.util.NavigableSet", "java.util.SortedSet", "java.util.TreeSet",
    "java.util.concurrent.ConcurrentSkipListSet", "java.util.concurrent.CopyOnWriteArraySet", "java.util.HashSet",
    "java.util.LinkedHashSet", "java.util.Set", "java.util.Queue", "java.util.AbstractCollection",
    "java.util.concurrent.CopyOnWriteArrayList", "java.util.concurrent.LinkedBlockingQueue", "java.util.Stack",
    "java.util.Map"]


def _lookup(mapping: dict, col) -> F.Column:
    return F.try_element_at(F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]), col)


def effective_fields(class_fields: DataFrame, enums: DataFrame | None = None) -> DataFrame:
    """J6 field rules: skip transient fields; rename by ``SerializedName`` /
    ``Json(name=)``; when any field of a class is ``Expose``d keep only exposed
    ones (bare or ``serialize=true``). Adds the node shape of each field:
    ``leaf`` (tag), ``array`` (element tag or element class), ``map`` (String
    keys; value tag or class) or ``object`` (class)."""
    ann = F.coalesce(F.col("annotations"), F.array().cast("array<struct<name:string,key:string,value:string>>"))
    nm = lambda a: F.coalesce(a["name"], F.lit(""))  # noqa: E731  (annotation parts may be NULL)
    ky = lambda a: F.coalesce(a["key"], F.lit(""))
    vl = lambda a: F.lower(F.coalesce(a["value"], F.lit("")))
    has_expose = F.exists(ann, lambda a: nm(a) == "Expose")
    serialize_false = F.exists(ann, lambda a: (nm(a) == "Expose") & (ky(a) == "serialize") & (vl(a) != "true"))
    exposed_ok = has_expose & ~serialize_false
    rename = F.try_element_at(F.filter(ann, lambda a: (nm(a) == "SerializedName")
                                       | ((nm(a) == "Json") & (ky(a) == "name"))), F.lit(-1))["value"]
    w = Window.partitionBy("project", "class")
    cf = class_fields.withColumn("_exp", F.max(has_expose.cast("int")).over(w)) \
        .filter(~F.coalesce(F.col("is_transient"), F.lit(False))) \
        .filter((F.col("_exp") == 0) | exposed_ok) \
        .withColumn("key", F.coalesce(rename, F.col("field")))
    enum_types = (enums.select("project", F.col("class").alias("ref_class"), F.lit(1).alias("_enum")).distinct()
                  if enums is not None else None)
    simple = lambda t: _lookup(SIMPLE_TAGS, t)
    short = lambda t: F.regexp_replace(t, r"^.*\.", "")
    is_coll = F.col("type").isin(COLLECTION_TYPES) | F.concat(F.lit("java.util."), F.col("type")).isin(COLLECTION_TYPES) \
        | F.concat(F.lit("java.util.concurrent."), F.col("type")).isin(COLLECTION_TYPES)
    is_map = short(F.col("type")) == "Map"
    targs = F.coalesce(F.col("type_args"), F.array().cast("array<string>"))
    elem = F.when(is_map, targs[1]).otherwise(targs[0])
    shaped = cf.withColumn("_is_enum", F.coalesce(F.col("is_enum"), F.lit(False))) \
        .withColumn("shape", F.when(is_coll & ~is_map & (F.size(targs) == 1), "array")
                    .when(is_map & (F.size(targs) == 2) & (short(targs[0]) == "String"), "map")
                    .when(is_coll, None)
                    .when(simple(F.col("type")).isNotNull() | F.col("_is_enum"), "leaf")
                    .otherwise("object")) \
        .filter(F.col("shape").isNotNull()) \
        .withColumn("elem", F.when(F.col("shape").isin("array", "map"), elem)) \
        .withColumn("tag", F.when(F.col("shape") == "leaf", F.coalesce(simple(F.col("type")), F.lit("STRING")))
                    .when(F.col("shape").isin("array", "map"), simple(F.col("elem")))) \
        .withColumn("ref_class", F.when(F.col("shape") == "object", short(F.col("type")))
                    .when(F.col("shape").isin("array", "map") & F.col("tag").isNull(), short(F.col("elem"))))
    if enum_types is not None:
        # enum classes are corpus data: no broadcast hint, AQE picks the join from runtime sizes
        shaped = shaped.join(enum_types, ["project", "ref_class"], "left") \
            .withColumn("tag", F.when(F.col("_enum").isNotNull(), F.lit("STRING")).otherwise(F.col("tag"))) \
            .withColumn("ref_class", F.when(F.col("_enum").isNotNull(), None).otherwise(F.col("ref_class"))) \
            .withColumn("shape", F.when((F.col("shape") == "object") & F.col("_enum").isNotNull(), "leaf")
                        .otherwise(F.col("shape"))).drop("_enum")
    return shaped.select("project", "class", "field", "key", "shape", "tag", "ref_class")


def _same_cycle(ef: DataFrame) -> DataFrame:
    """(project, class, ref_class): references between classes of one cycle (each reaches the other)."""
    from apiatlas.operators.resolve import reach
    refs = ef.filter("ref_class IS NOT NULL").select("project", F.col("class").alias("cur"), F.col("ref_class").alias("nxt")).distinct()
    own = refs.select("project", "cur").distinct()
    inner = write_table(refs.join(own.withColumnRenamed("cur", "nxt"), ["project", "nxt"], "left_semi").select("project", "cur", "nxt"))
    pairs = reach(own.select("project", F.col("cur").alias("start"), "cur"), inner).select("project", "start", "cur")
    back = pairs.select("project", F.col("cur").alias("start"), F.col("start").alias("cur"))
    return inner.join(pairs.join(back, ["project", "start", "cur"], "left_semi").toDF("project", "nxt", "cur"), ["project", "cur", "nxt"], "left_semi") \
        .toDF("project", "class", "ref_class")


def schema_from_fields(class_fields: DataFrame, roots: DataFrame, max_depth: int | None = None,
                       enums: DataFrame | None = None) -> DataFrame:
    """Class-field table -> JSON skeleton per root class.

    ``roots(project, class)``; fields come from ``effective_fields``. A nested class is an object; a
    collection of a class lists one ``{key: value}`` object per field; a ``Map<String, V>`` is
    ``[{"": V}]``; keys are sorted; a class that is already on its own path renders as an empty
    object. Output ``(project, class, skeleton)``.

    Each class is rendered once, from the texts of the classes it refers to, however many paths
    lead to it. What it renders to depends on the path only among the classes of its own cycle, so
    it is a class together with those of them that are on the path which is rendered once. First
    such pairs are found along the cycles, then all are rendered from the leaves up; a round is a
    few equi-joins and is written once. With ``max_depth`` (default: none) the tree of paths is
    expanded to that depth instead.
    """
    from apiatlas.session import RoundTable
    ef = write_table(effective_fields(class_fields, enums))
    if max_depth is not None:
        return _expanded_paths(ef, roots, max_depth)
    spark = class_fields.sparkSession
    cycles = write_table(_same_cycle(ef))
    cyclic = cycles.select("project", F.col("class").alias("child")).distinct()
    # a field's reference: into its own cycle, or to a class that begins a path of its own
    fields = ef.join(cycles.withColumn("inner", F.lit(True)), ["project", "class", "ref_class"], "left") \
        .join(cyclic.withColumnRenamed("child", "ref_class").withColumn("ref_cyclic", F.lit(True)), ["project", "ref_class"], "left")
    fields = write_table(fields.groupBy("project", "class", "key").agg(F.min_by(  # of equal keys one
        F.struct("shape", "tag", "ref_class", "inner", "ref_cyclic"), F.struct("shape", "tag", "ref_class")).alias("f")).select("project", "class", "key", "f.*"))
    state = lambda cls, trail: F.concat_ws("\u0000", cls, trail)
    empty = F.array().cast("array<string>")
    def beginning(classes: DataFrame) -> DataFrame:
        known = classes.select("project", "class").distinct().join(cyclic.withColumnRenamed("child", "class").withColumn("c", F.lit(True)), ["project", "class"], "left")
        return known.withColumn("trail", F.when(F.col("c"), F.array("class")).otherwise(empty)).select(
            "project", "class", "trail", state(F.col("class"), F.col("trail")).alias("sid"))

    begin = beginning(roots)
    states, kids = RoundTable(spark), RoundTable(spark)
    # every class begins a path; further rounds follow the cycles only
    refs = fields.filter("ref_class IS NOT NULL").select("project", F.col("ref_class").alias("class"))
    new = states.add(beginning(roots.select("project", "class").unionByName(fields.select("project", "class")).unionByName(refs)))
    while not new.isEmpty():
        again = F.col("inner") & F.array_contains("trail", F.col("ref_class"))
        trail = F.when(F.col("inner"), F.array_sort(F.array_append("trail", F.col("ref_class")))) \
            .when(F.col("ref_cyclic"), F.array("ref_class")).otherwise(empty)
        found = new.select("project", "class", "trail", "sid").join(fields, ["project", "class"]) \
            .withColumn("child", F.when(~F.coalesce(again, F.lit(False)), F.col("ref_class"))).withColumn("child_trail", trail)
        found = kids.add(found.select("project", "sid", "key", "shape", "tag", "child", "child_trail", F.when(
            F.col("child").isNotNull(), state(F.col("child"), F.col("child_trail"))).alias("child_sid")))
        new = states.add(found.filter("child IS NOT NULL").select("project", F.col("child").alias("class"), F.col("child_trail").alias("trail"),
                                                                  F.col("child_sid").alias("sid")).distinct()
                         .join(states.all().select("project", "sid"), ["project", "sid"], "left_anti").select("project", "class", "trail", "sid"))
    every, links = states.all().select("project", "class", "sid"), kids.all()
    texts, pending = RoundTable(spark), every
    while True:
        if texts.rounds:
            done = texts.all().select("project", "sid")
            pending = every.join(done, ["project", "sid"], "left_anti")
            waiting = links.filter("child_sid IS NOT NULL").join(done.withColumnRenamed("sid", "child_sid"), ["project", "child_sid"], "left_anti")
        else:
            waiting = links.filter("child_sid IS NOT NULL")
        ready = pending.join(waiting.select("project", "sid").distinct(), ["project", "sid"], "left_anti")
        rows = links.join(ready.select("project", "sid"), ["project", "sid"], "left_semi")
        if texts.rounds:
            rows = rows.join(texts.all().select("project", F.col("sid").alias("child_sid"), "object", "elements"), ["project", "child_sid"], "left")
        else:
            rows = rows.withColumns({"object": F.lit(None).cast("string"), "elements": F.lit(None).cast("string")})
        leaf, nested = F.concat(F.lit('"<'), F.col("tag"), F.lit('>"')), F.coalesce("object", F.lit("{}"))
        value = F.when(F.col("shape") == "leaf", leaf).when(F.col("shape") == "object", nested) \
            .when(F.col("shape") == "map", F.concat(F.lit('[{"":'), F.coalesce(leaf, nested), F.lit("}]"))) \
            .when(F.col("tag").isNotNull(), F.concat(F.lit("["), leaf, F.lit("]"))).otherwise(F.coalesce("elements", F.lit("[]")))
        pairs = F.sort_array(F.collect_list(F.struct("key", F.concat(json_string(F.col("key")), F.lit(":"), value).alias("pair"))))
        made = rows.groupBy("project", "sid").agg(pairs.alias("pairs"))
        join = lambda items: F.coalesce(F.array_join(items, ","), F.lit(""))
        new = texts.add(ready.select("project", "sid").join(made, ["project", "sid"], "left").select(
            "project", "sid", F.concat(F.lit("{"), join(F.transform("pairs", lambda p: p["pair"])), F.lit("}")).alias("object"),
            F.concat(F.lit("["), join(F.transform("pairs", lambda p: F.concat(F.lit("{"), p["pair"], F.lit("}")))), F.lit("]")).alias("elements")))
        if new.isEmpty():
            break
    return begin.join(texts.all().select("project", "sid", "object"), ["project", "sid"]).select("project", "class", F.col("object").alias("skeleton"))


def _expanded_paths(ef: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """J6 to a depth: the tree is expanded one class level per round (equi-join of the frontier's
    referenced class with the field table), a class on its own path not again, and rendered by J3."""
    spark = ef.sparkSession
    from apiatlas.session import RoundTable
    cols = ["project", "root", "path", "parent_path", "key", "idx", "depth", "jtype", "expand", "mode", "trail"]
    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    frontier = roots.select("project", F.col("class").alias("root"), F.lit("$").alias("path"),
                            none_s.alias("parent_path"), none_s.alias("key"), none_i.alias("idx"),
                            F.lit(0).alias("depth"), F.lit("OBJECT").alias("jtype"),
                            F.col("class").alias("expand"), F.lit("object").alias("mode"), F.array("class").alias("trail"))
    levels = RoundTable(spark)
    frontier = levels.add(frontier.select(*cols))
    while levels.rounds <= max_depth and not frontier.isEmpty():
        k = frontier.alias("f").join(ef.alias("e"), (F.col("f.project") == F.col("e.project"))
                                     & (F.col("f.expand") == F.col("e.class"))) \
            .select(F.col("f.project").alias("project"), "root", F.col("f.path").alias("parent"),
                    F.col("f.depth").alias("pdepth"), "mode", "trail", F.col("e.key").alias("key"), "shape", "tag", "ref_class")
        k = k.withColumn("eidx", (F.row_number().over(Window.partitionBy("project", "root", "parent")
                                                      .orderBy("key")) - 1).cast("int"))
        as_el = F.col("mode") == "elements"
        k = k.withColumn("fparent", F.when(as_el, F.concat("parent", F.lit("["), F.col("eidx").cast("string"),
                                                          F.lit("]"))).otherwise(F.col("parent"))) \
            .withColumn("fdepth", F.col("pdepth") + 1 + as_el.cast("int")) \
            .withColumn("fpath", child_path(F.col("fparent"), F.col("key"), F.lit(0))) \
            .withColumn("again", F.array_contains("trail", F.col("ref_class"))) \
            .withColumn("ref_class", F.when(~F.coalesce("again", F.lit(False)), F.col("ref_class"))) \
            .withColumn("trail", F.when(F.col("ref_class").isNotNull(), F.array_append("trail", F.col("ref_class"))).otherwise(F.col("trail")))
        elements = k.filter(as_el).select(
            "project", "root", F.col("fparent").alias("path"), F.col("parent").alias("parent_path"),
            none_s.alias("key"), F.col("eidx").alias("idx"), (F.col("pdepth") + 1).alias("depth"),
            F.lit("OBJECT").alias("jtype"), none_s.alias("expand"), none_s.alias("mode"), "trail")
        shape = F.col("shape")
        fields = k.select(
            "project", "root", F.col("fpath").alias("path"), F.col("fparent").alias("parent_path"), "key",
            none_i.alias("idx"), F.col("fdepth").alias("depth"),
            F.when(shape == "leaf", F.col("tag")).when(shape == "object", F.lit("OBJECT"))
            .otherwise(F.lit("ARRAY")).alias("jtype"),
            F.when(shape == "object", F.col("ref_class"))
            .when((shape == "array") & F.col("tag").isNull(), F.col("ref_class")).alias("expand"),
            F.when(shape == "object", F.lit("object"))
            .when((shape == "array") & F.col("tag").isNull(), F.lit("elements")).alias("mode"), "trail")
        arr_leaf = k.filter((shape == "array") & F.col("tag").isNotNull()).select(
            "project", "root", F.concat("fpath", F.lit("[0]")).alias("path"), F.col("fpath").alias("parent_path"),
            none_s.alias("key"), F.lit(0).alias("idx"), (F.col("fdepth") + 1).alias("depth"),
            F.col("tag").alias("jtype"), none_s.alias("expand"), none_s.alias("mode"), "trail")
        map_el = k.filter(shape == "map").select(
            "project", "root", F.concat("fpath", F.lit("[0]")).alias("path"), F.col("fpath").alias("parent_path"),
            none_s.alias("key"), F.lit(0).alias("idx"), (F.col("fdepth") + 1).alias("depth"),
            F.lit("OBJECT").alias("jtype"), none_s.alias("expand"), none_s.alias("mode"), "trail")
        map_val = k.filter(shape == "map").select(
            "project", "root", F.concat("fpath", F.lit("[0].")).alias("path"),
            F.concat("fpath", F.lit("[0]")).alias("parent_path"), F.lit("").alias("key"), none_i.alias("idx"),
            (F.col("fdepth") + 2).alias("depth"), F.coalesce(F.col("tag"), F.lit("OBJECT")).alias("jtype"),
            F.when(F.col("tag").isNull(), F.col("ref_class")).alias("expand"),
            F.when(F.col("tag").isNull(), F.lit("object")).alias("mode"), "trail")
        new = elements.select(*cols).unionByName(fields.select(*cols)).unionByName(arr_leaf.select(*cols)) \
            .unionByName(map_el.select(*cols)).unionByName(map_val.select(*cols))
        frontier = levels.add(new).filter(F.col("expand").isNotNull())
    allnodes = levels.all()
    fields_df = allnodes.select("project", F.concat_ws("#", "project", "root").alias("model_id"), "path",
                                "parent_path", "key", "idx", "depth", "jtype",
                                F.lit(None).cast("string").alias("value"))
    sk = json_skeleton(fields_df)
    return sk.select("project", F.regexp_replace("model_id", r"^[^#]*#", "").alias("class"), "skeleton")


# --------------------------------------------------------------------------- J6c
GSON, MOSHI = "com.google.code.gson", "com.squareup.moshi"
# Types of the scope of a serializer call, and converter factories of route builders.
SERIALIZER_TYPES = {"com.google.gson.Gson": GSON, "Gson": GSON, "com.google.gson.GsonBuilder": GSON, "GsonBuilder": GSON,
                    "com.squareup.moshi.JsonAdapter": MOSHI, "JsonAdapter": MOSHI, "com.squareup.moshi.Moshi": MOSHI, "Moshi": MOSHI}
CONVERTER_FACTORIES = {"GsonConverterFactory": GSON, "MoshiConverterFactory": MOSHI}


def converter_libraries(builder_calls: DataFrame) -> DataFrame:
    """``builder_calls(project, client, pos, call, arg_scope)`` -> ``(project, client,
    library)``: the serializer of the client's last ``addConverterFactory`` call with a known
    factory; clients without one have no row."""
    library = F.when(F.col("call") == "addConverterFactory", _lookup(CONVERTER_FACTORIES, F.col("arg_scope")))
    return builder_calls.select("project", "client", "pos", library.alias("library")).filter("library IS NOT NULL") \
        .groupBy("project", "client").agg(F.max_by("library", "pos").alias("library"))


def serializer_models(calls: DataFrame, class_fields: DataFrame, enums: DataFrame | None = None) -> DataFrame:
    """J6 with J6c: ``calls(project, class, scope_type)`` of serializers -> ``(project, class,
    library, skeleton)``, one row per class and library; calls on other types are left out."""
    tagged = calls.select("project", "class", _lookup(SERIALIZER_TYPES, F.col("scope_type")).alias("library")) \
        .filter("library IS NOT NULL").distinct()
    schemas = schema_from_fields(class_fields, tagged.select("project", "class").distinct(), enums=enums)
    return tagged.join(schemas, ["project", "class"]).select("project", "class", "library", "skeleton")


# --------------------------------------------------------------------------- J7
def request_body_models(body_texts: DataFrame, body_routes: DataFrame | None = None,
                        class_fields: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """Request bodies -> models. Text bodies (second argument of a body
    ``create(type, text)``) go through J1 with library ``OkHttp``; route
    ``@Body`` parameter types go through J6 with the route's converter library.
    ``body_texts(project, path, text, ord)``, ``body_routes(project, type, library)``.
    Output ``(project, model, library, kind)``."""
    t = build_json_models(body_texts.withColumn("library", F.lit("OkHttp"))) \
        .select("project", F.col("canonical").alias("model"), "library", F.lit("text").alias("kind"))
    if body_routes is None or class_fields is None:
        return t
    roots = body_routes.select("project", F.col("type").alias("class")).distinct()
    sk = schema_from_fields(class_fields, roots, max_depth)
    libs = body_routes.select("project", F.col("type").alias("class"), "library").distinct()
    c = sk.join(libs, ["project", "class"]).select("project", F.col("skeleton").alias("model"), "library",
                                                   F.lit("class").alias("kind"))
    return t.unionByName(c)
