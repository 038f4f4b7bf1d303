"""Extraction jobs P1-P6 and the span filter F4: projections with explode over text.

The reference walks a Java syntax tree; here the same facts come from regular
expressions over the text (users with a real parser can supply the fact tables
instead). Each job is narrow (no shuffle) except where a set is aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apiatlas.functions import encoding as enc

# A double-quoted literal with backslash escapes.
STRING_LITERAL = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
# `[String] name = "value"` in free text, where the type word is optional.
STRING_ASSIGNMENT = r'(?:String\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
IMPORT_LINE = r"(?m)^\s*import\s+(?:static\s+)?([A-Za-z_][\w.]*(?:\.\*)?)\s*;"


# The whole text as pieces: comments, string and character literals, anything else.
PIECE = (r"//[^\n]*+|/\*[\s\S]*?(?:\*/|\z)|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\""
         r"|'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]{0,4})'|[^/\"']++|[\s\S]")


def tokenised(texts: DataFrame, text_col: str = "content") -> DataFrame:
    """``texts`` with ``_pieces`` (the text cut into comments, literals and the rest),
    ``_code`` (the text without comments and character literals, lines kept) and ``_masked``
    (``_code`` with each string literal replaced by the number of its piece). A narrow
    projection that P1, P3, P4 and P5 share; they add it themselves where it is missing."""
    if "_pieces" in texts.columns:
        return texts
    comment = lambda t: F.when(F.startswith(t, F.lit("//")), F.lit("")).when(
        F.startswith(t, F.lit("/*")), F.regexp_replace(t, r"[^\n]", "")).when(
        F.startswith(t, F.lit("'")) & (F.length(t) > 1), F.lit("' '"))
    quoted = lambda t: F.startswith(t, F.lit('"')) & (F.length(t) > 1)
    p = texts.withColumn("_pieces", F.regexp_extract_all(F.col(text_col), F.lit(PIECE), F.lit(0)))
    return p.withColumns({
        "_code": F.array_join(F.transform("_pieces", lambda t: F.coalesce(comment(t), t)), ""),
        "_masked": F.array_join(F.transform("_pieces", lambda t, i: F.coalesce(
            comment(t), F.when(quoted(t), F.concat(F.lit('"'), i.cast("string"), F.lit('"'))), t)), "")})


def unmasked(text):
    """``text`` of a masked source with its string literals put back."""
    return F.aggregate(F.regexp_extract_all(text, F.lit(r'"(\d+)"'), F.lit(1)), text, lambda acc, k: F.replace(
        acc, F.concat(F.lit('"'), k, F.lit('"')), F.get("_pieces", k.cast("int"))))


def extract_literals(texts: DataFrame, text_col: str = "content", keys=("project", "path")) -> DataFrame:
    """Every string literal outside comments, with 0-based line number and position in its line.

    Output ``(*keys, line, pos, literal, kind)``; ``kind`` is ``url`` when the
    unescaped literal starts with an accepted scheme, else ``text``.
    """
    lines = tokenised(texts, text_col).select(*keys, F.posexplode(F.split("_code", "\n")).alias("line", "_l"))
    lits = lines.select(*keys, "line", F.posexplode(F.regexp_extract_all("_l", F.lit(STRING_LITERAL), 1))
                        .alias("pos", "literal"))
    un = enc.unescape_java(F.col("literal"))
    is_url = (un.startswith("https://") | un.startswith("http://") | un.startswith("www.")
              | un.startswith("ws://") | un.startswith("wss://"))
    return lits.withColumn("kind", F.when(is_url, "url").otherwise("text"))


# A declaration of String variables in masked code, and those of its variables that a literal alone initialises.
STRING_DECLARATION = r"\bString\s+[A-Za-z_$][\w$]*\s*=[^;{}]*"
LITERAL_VARIABLE = r'([A-Za-z_$][\w$]*)\s*=\s*"(\d+)"\s*(?:,|\z)'


def collect_string_vars(texts: DataFrame, text_col: str = "content", project_col: str = "project", pattern: str | None = None) -> DataFrame:
    """String declarations with a literal -> one row per (project, name) with the
    sorted set of values. Partial aggregation dedupes values before the shuffle."""
    pairs = string_var_sites(texts, text_col, (project_col,), pattern).withColumnRenamed(project_col, "project")
    return pairs.groupBy("project", "name").agg(F.sort_array(F.collect_set("value")).alias("values"))


def string_var_sites(texts: DataFrame, text_col: str = "content", keys=("project", "path"), pattern: str | None = None) -> DataFrame:
    """The (project, path, name, value) sites behind P2, one row per variable: variables of a declaration
    of type ``String`` (not of arrays) whose initialiser is one string literal and no more. Comments,
    annotations and assignments hold none. With ``pattern`` (two groups: name and value) its matches in
    the raw text are the sites instead, for texts that are no source code."""
    # every match needs '=': the cheap containment test skips the regex on most texts
    texts = texts.filter(F.col(text_col).contains("="))
    if pattern is not None:
        m = texts.select(*keys, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0)).alias("_m"))
        return m.select(*keys, F.regexp_extract("_m", pattern, 1).alias("name"), F.regexp_extract("_m", pattern, 2).alias("value"))
    m = tokenised(texts, text_col).select(*keys, "_pieces", F.explode(F.regexp_extract_all("_masked", F.lit(STRING_DECLARATION), F.lit(0))).alias("_d"))
    # arguments of calls in the declaration are none of its variables
    m = m.select(*keys, "_pieces", F.explode(F.regexp_extract_all(_without_nested(F.col("_d")), F.lit(LITERAL_VARIABLE), F.lit(0))).alias("_m"))
    return m.select(*keys, F.regexp_extract("_m", LITERAL_VARIABLE, 1).alias("name"), _literal(F.regexp_extract("_m", LITERAL_VARIABLE, 2)).alias("value"))


def extract_imports(texts: DataFrame, library_dim: DataFrame, text_col: str = "content",
                    keys=("project", "path")) -> DataFrame:
    """Import names that contain a known library id -> (keys, import, library).

    The library dimension is a fixed 21-row table; Spark checks its size and broadcasts it
    for the containment (non-equi) join."""
    imps = texts.select(*keys, F.explode(F.regexp_extract_all(F.col(text_col), F.lit(IMPORT_LINE), 1))
                        .alias("import"))
    libs = library_dim.select("library")
    return imps.join(libs, F.col("import").contains(F.col("library")), "inner")


def keep_maximal_spans(spans: DataFrame, key: str = "path", start: str = "start", end: str = "end",
                       num_partitions: int | None = None) -> DataFrame:
    """of nested spans keep only the outermost.

    Ordered by (start asc, end desc) inside a key, a span survives when it
    ends after every span before it (a running max). The rows are
    range-partitioned on (key, start, -end), so one file with a third of all
    spans is spread over many tasks: each partition computes its local
    running max, and the max of the earlier partitions of the same key (a
    small per-partition table) is carried in.
    """
    from apiatlas.session import materialize
    spark = spans.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(spans.repartitionByRange(n, F.col(key), F.col(start), F.col(end).desc())
                         .withColumn("_pid", F.spark_partition_id()))
    local = Window.partitionBy("_pid", key).orderBy(F.col(start).asc(), F.col(end).desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    part_max = ranged.groupBy("_pid", key).agg(F.max(end).alias("_pmax"))
    carry = part_max.withColumn("_carry", F.max("_pmax").over(
        Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1))).drop("_pmax")
    prev = F.greatest(F.max(end).over(local), F.col("_carry"))
    return ranged.join(carry, ["_pid", key]).withColumn("_prev_end", prev) \
        .filter(F.col("_prev_end").isNull() | (F.col(end) > F.col("_prev_end"))) \
        .drop("_prev_end", "_carry", "_pid")


# ------------------------------------------------------------------ P3-P5
CREATION = r"\bnew\s+([A-Za-z_][\w.]*)\s*(?:<[^<>()]*>)?\s*\("
CALL = r"(?:\b([A-Za-z_]\w*+(?:\(\))?)\s*\.\s*)?\b([a-z_]\w*+)\s*\("
CAST = r"\(\s*([A-Z][\w.]*)\s*\)\s*(?:[\w.]+\s*\.\s*)?([a-z_][\w]*)\s*\("
NO_CALL = ("if", "for", "while", "switch", "catch", "return", "new", "synchronized")


def _balanced(depth: int) -> str:
    """A run without an unmatched parenthesis, nested up to ``depth`` times."""
    return r"[^()]*+" if depth == 0 else rf"(?:[^()]++|\({_balanced(depth - 1)}\))*+"


NESTED = rf"\({_balanced(6)}\)"
ROUTE = (r"((?:@\w+(?:\s*\((?:[^()]++|\([^()]*+\))*+\))?\s*)+)"
         r"[\w.<>\[\], ?]+?\s+(\w+)\s*\(((?:[^()]++|\([^()]*+\))*+)\)")
VERB_ANNOTATION = r"@(GET|POST|PUT|PATCH|DELETE)\s*\(\s*(?:value\s*=\s*)?\"(\d+)\"[^)]*\)"
ROUTE_PARAM = r"@(\w+)\s*(?:\(\s*(?:value\s*=\s*)?(?:\"(\d+)\")?[^)]*\))?\s*(?:final\s+)?([\w.]+(?:<.*>)?(?:\[\])?)\s+\w+\s*$"
# a comma between parameters: not inside type arguments or an annotation's parentheses
PARAM_COMMA = r",(?![^<]*>)(?![^()]*\))"
FIELD = (r"(?m)^[ \t]*((?:@\w+(?:\([^)]*\))?\s*)*)(?:(public|protected|private)\s+)?((?:(?:static|final|transient|volatile)\s+)*)"
         r"([A-Za-z_][\w.]*)(?:<([^;=()]*)>)?(?:\[\])*\s+([A-Za-z_]\w*)\s*(?:=[^;]*)?(?:;|\z)")
ANNOTATION = r"@(\w+)(?:\(([^)]*)\))?"
TYPE_DECL = r"\b(?:class|interface|enum)\s+(\w+)"
# words that never are a field's type
NO_TYPE = ("return", "throw", "new", "package", "import", "class", "interface", "enum", "else", "case", "extends", "implements",
           "assert", "goto", "break", "continue", "instanceof")


def _stretches(text):
    """``text`` cut behind each parenthesis."""
    return F.regexp_extract_all(text, F.lit(r"[^()]*+[()]|[^()]++"), F.lit(0))


def _step(s):
    """What a stretch adds to the number of open parentheses."""
    return F.when(F.endswith(s, F.lit("(")), F.lit(1)).when(F.endswith(s, F.lit(")")), F.lit(-1)).otherwise(F.lit(0))


def _to_close(text):
    """``text`` up to the parenthesis that closes one opened before it; NULL if none does."""
    start = F.struct(F.lit(1).alias("open"), F.lit(0).alias("size"))
    return F.aggregate(_stretches(text), start, lambda state, s: F.when(state["open"] == 0, state).otherwise(F.struct(
        (state["open"] + _step(s)).alias("open"), (state["size"] + F.length(s)).alias("size"))),
        lambda state: F.when(state["open"] == 0, F.substring(text, F.lit(1), state["size"] - 1)))


def _without_nested(text):
    """``text`` without what stands inside its parentheses, however deep."""
    start = F.struct(F.lit(0).alias("open"), F.lit("").alias("out"))
    return F.aggregate(_stretches(text), start, lambda state, s: F.struct(
        (state["open"] + _step(s)).alias("open"),
        F.when(state["open"] == 0, F.concat(state["out"], s))
        .when((state["open"] == 1) & F.endswith(s, F.lit(")")), F.concat(state["out"], F.lit(")")))
        .otherwise(state["out"]).alias("out")), lambda state: state["out"])


def extract_calls(texts: DataFrame, text_col: str = "content", keys=("project", "path")) -> DataFrame:
    """Call, creation and cast sites per line -> ``call_site(keys, line, pos, kind,
    name, scope, scope_type, args, arg_types)``, from the text without comments; calls inside
    another call's arguments are sites of their own. One scan: the three kinds come from one
    projection. ``args`` are the arguments between top-level commas, with the arguments of calls
    inside them left out, nested to any depth and over any number of lines; a site's head stands
    in one line, and a list that nothing closes is read to the end of its line. Types are unknown
    (NULL) unless a real parser supplies the table."""
    keys = list(keys)
    lines = tokenised(texts, text_col).select(*keys, "_pieces", F.split("_masked", "\n").alias("_ls")) \
        .select("*", F.posexplode("_ls").alias("line", "_l")).filter(F.contains("_l", F.lit("(")))
    closed = "^(" + _balanced(6) + r")\)"

    # the heads of each kind and what stands between them, found once a line
    lines = lines.select("*", F.regexp_extract_all("_l", F.lit(CREATION), F.lit(0)).alias("_new"),
                         F.regexp_extract_all("_l", F.lit(CALL), F.lit(0)).alias("_call"),
                         F.regexp_extract_all("_l", F.lit(CAST), F.lit(0)).alias("_cast")) \
        .filter((F.size("_new") > 0) | (F.size("_call") > 0) | (F.size("_cast") > 0)) \
        .select("*", F.split("_l", CREATION, -1).alias("_after_new"), F.split("_l", CALL, -1).alias("_after_call"))

    def sites(heads, tails, pattern, kind, name_idx, scope_idx):
        def site(h, i):
            tail = F.get(tails, i + 1)
            # arguments that hold further heads: what follows, to the end of the line
            rest = F.concat(tail, F.array_join(F.zip_with(
                F.slice(heads, i + 2, F.size(heads)), F.slice(tails, i + 3, F.size(tails)),
                lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), ""))
            # or what follows to the end of the text, where the line doesn't close them
            after = F.concat(rest, F.lit("\n"), F.array_join(F.slice("_ls", F.col("line") + 2, F.size("_ls")), "\n"))
            inner = F.when(F.rlike(tail, F.lit(closed)), F.regexp_extract(tail, closed, 1)) \
                .when(F.rlike(rest, F.lit(closed)), F.regexp_extract(rest, closed, 1)) \
                .when(F.rlike(after, F.lit(closed)), F.regexp_extract(after, closed, 1)) \
                .otherwise(F.coalesce(_to_close(after), F.regexp_extract(rest, "^(" + _balanced(6) + ")", 1)))
            return F.struct(F.lit(kind).alias("kind"), i.alias("pos"),
                            F.substring_index(F.regexp_extract(h, pattern, name_idx), ".", -1).alias("name"),
                            (F.regexp_extract(h, pattern, scope_idx) if scope_idx else F.lit("")).alias("scope"), inner.alias("inner"))
        return F.transform(heads, site)

    casts = F.transform("_cast", lambda h, i: F.struct(
        F.lit("cast").alias("kind"), i.alias("pos"), F.substring_index(F.regexp_extract(h, CAST, 1), ".", -1).alias("name"),
        F.regexp_extract(h, CAST, 2).alias("scope"), F.lit("").alias("inner")))
    calls = F.filter(sites(F.col("_call"), F.col("_after_call"), CALL, "call", 2, 1), lambda c: ~c["name"].isin(*NO_CALL))
    every = F.concat(sites(F.col("_new"), F.col("_after_new"), CREATION, "creation", 1, None), calls, casts)
    flat = F.regexp_replace("inner", NESTED, "()")
    flat = F.when(F.rlike(flat, F.lit(r"\((?!\))")), _without_nested(F.col("inner"))).otherwise(flat)
    space = F.lit(" \t\r\n\f")
    args = F.when(F.trim("inner", space) == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.split(flat, ","), lambda a: F.trim(unmasked(a), space)))
    return lines.select(*keys, "line", "_pieces", F.inline(every)).select(
        *keys, "line", "pos", "kind", "name", F.when(F.col("scope") != "", F.col("scope")).alias("scope"),
        F.lit(None).cast("string").alias("scope_type"), args.alias("args"), F.lit(None).cast("array<string>").alias("arg_types"))


def _literal(number):
    """The contents of the string literal with a piece's number."""
    piece = F.get("_pieces", number.try_cast("int"))
    return F.substring(piece, F.lit(2), F.length(piece) - 2)


def extract_routes(texts: DataFrame, text_col: str = "content", keys=("project", "path")) -> DataFrame:
    """Annotated interface methods -> ``route(keys, iface, method, verb,
    template, params ARRAY<STRUCT<ann,arg,type,pos>>)``. Of several verb
    annotations on a method the last one wins; parameters keep their single
    annotation; ``iface`` is the interface declared last before the method."""
    t = tokenised(texts, text_col).select(*keys, "_pieces", F.explode(F.slice(
        F.split("_masked", r"\binterface\s+"), 2, 1 << 30)).alias("_body"))
    f = t.select(*keys, "_pieces", F.regexp_extract("_body", r"^(\w+)", 1).alias("iface"),
                 F.explode(F.regexp_extract_all("_body", F.lit(ROUTE), F.lit(0))).alias("_m"))
    verbs = F.regexp_extract_all(F.regexp_extract("_m", ROUTE, 1), F.lit(VERB_ANNOTATION), F.lit(0))
    last_verb = F.try_element_at(verbs, F.lit(-1))
    params = F.transform(F.split(F.regexp_extract("_m", ROUTE, 3), PARAM_COMMA), lambda p, i: F.struct(
        F.regexp_extract(p, ROUTE_PARAM, 1).alias("ann"), F.coalesce(_literal(F.regexp_extract(p, ROUTE_PARAM, 2)), F.lit("")).alias("arg"),
        F.regexp_extract(p, ROUTE_PARAM, 3).alias("type"), i.alias("pos")))
    return f.filter(F.size(verbs) > 0).select(
        *keys, "iface", F.regexp_extract("_m", ROUTE, 2).alias("method"),
        F.regexp_extract(last_verb, VERB_ANNOTATION, 1).alias("verb"),
        _literal(F.regexp_extract(last_verb, VERB_ANNOTATION, 2)).alias("template"),
        F.filter(params, lambda p: p["ann"] != "").alias("params"))


def _type_bodies(masked):
    """What stands directly in the braces of each type: array of (class, text), in order. A
    stack of the open braces' types (empty for other braces) says where a stretch stands."""
    out = "array<struct<class:string,text:string>>"
    stretch = F.regexp_extract_all(masked, F.lit(r"[^{}]*+[{}]|[^{}]++"), F.lit(0))

    def step(state, s):
        body = F.regexp_replace(s, r"[{}]\z", "")
        top = F.coalesce(F.try_element_at(state["stack"], F.lit(-1)), F.lit(""))
        head = F.regexp_extract(body, r"[^;]*\z", 0)
        name = F.when(F.rlike(head, F.lit(r"\benum\s")), F.lit("")).otherwise(F.regexp_extract(head, TYPE_DECL, 1))
        stack = F.when(F.endswith(s, F.lit("{")), F.array_append(state["stack"], name)) \
            .when(F.endswith(s, F.lit("}")), F.slice(state["stack"], 1, F.greatest(F.size(state["stack"]) - 1, F.lit(0)))) \
            .otherwise(state["stack"])
        return F.struct(stack.alias("stack"), F.when(top != "", F.array_append(state["out"], F.struct(
            top.alias("class"), body.alias("text")))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast(out).alias("out"))
    return F.aggregate(stretch, start, step, lambda state: state["out"])


def extract_fields(texts: DataFrame, text_col: str = "content", keys=("project", "path")) -> DataFrame:
    """P5: field declarations -> ``class_field(keys, class, field, type, type_args,
    is_enum, is_transient, visibility, annotations ARRAY<STRUCT<name,key,value>>)``. A field
    belongs to the type whose braces it stands in directly, so locals are none; static
    fields are left out; ``is_enum`` says that the file declares the field's type as an enum."""
    t = tokenised(texts, text_col).select(
        *keys, "_pieces", F.regexp_extract_all("_masked", F.lit(r"\benum\s+(\w+)"), F.lit(1)).alias("_enums"),
        F.inline(_type_bodies(F.col("_masked"))))
    f = t.select(*keys, "_pieces", "_enums", "class", F.explode(F.regexp_extract_all("text", F.lit(FIELD), F.lit(0))).alias("_m"))
    anns = F.transform(F.regexp_extract_all(F.regexp_extract("_m", FIELD, 1), F.lit(ANNOTATION), F.lit(0)), lambda a: F.struct(
        F.regexp_extract(a, ANNOTATION, 1).alias("name"),
        F.when(F.regexp_extract(a, ANNOTATION, 2).contains("="),
               F.trim(F.regexp_extract(a, r"\(\s*(\w+)\s*=", 1))).alias("key"),
        F.coalesce(_literal(F.regexp_extract(a, r'"(\d+)"', 1)),
                   F.regexp_extract(F.regexp_extract(a, ANNOTATION, 2), r"(?:=\s*)?([^\")=]*)\s*$", 1)).alias("value")))
    targs, kind = F.regexp_extract("_m", FIELD, 5), F.regexp_extract("_m", FIELD, 4)
    return f.filter(~kind.isin(*NO_TYPE) & ~F.rlike(F.regexp_extract("_m", FIELD, 3), F.lit(r"\bstatic\b"))).select(
        *keys, "class", F.regexp_extract("_m", FIELD, 6).alias("field"), kind.alias("type"),
        F.when(targs == "", F.array().cast("array<string>"))
        .otherwise(F.transform(F.split(targs, ",(?![^<]*>)"), lambda a: F.trim(a))).alias("type_args"),
        F.array_contains("_enums", kind).alias("is_enum"),
        F.rlike(F.regexp_extract("_m", FIELD, 3), F.lit(r"\btransient\b")).alias("is_transient"),
        F.coalesce(F.nullif(F.regexp_extract("_m", FIELD, 2), F.lit("")), F.lit("default")).alias("visibility"),
        anns.alias("annotations"))


def extract_enums(texts: DataFrame, text_col: str = "content", project_col: str = "project") -> DataFrame:
    """``(project, class)`` of every enum declared in the texts (input of J6)."""
    return tokenised(texts, text_col).select(F.col(project_col).alias("project"), F.explode(
        F.regexp_extract_all("_masked", F.lit(r"\benum\s+(\w+)"), F.lit(1))).alias("class")).distinct()


CLASS_DECL = r"^\s*(?:(?:public|protected|private|abstract|final|static)\s+)*(?:class|interface|enum)\s+(\w+)"
METHOD_DECL = (r"^\s*(?:(?:public|protected|private|static|final|synchronized|abstract)\s+)*"
               r"(?:[\w.<>\[\], ?]+\s+)?(\w+)\s*\([^;{]*\)\s*(?:throws\s+[\w., ]+)?\s*\{?\s*$")


def extract_blocks(texts: DataFrame, text_col: str = "content", keys=("project", "path")) -> DataFrame:
    """Method/constructor and class blocks per file, in texts of any braces (``program.extract_blocks``
    gives the real ends in sources): ``(keys, kind, name, start_line, end_line)``. Line based: a class spans
    from its declaration to the end of the file, a method from its signature
    line to the line before the next declaration (or the end of the file).
    The window runs per file (one document)."""
    keys = list(keys)
    lines = texts.select(*keys, F.posexplode(F.split(F.col(text_col), "\n")).alias("line", "_l"))
    last = lines.groupBy(*keys).agg(F.max("line").alias("_last"))
    cls = F.regexp_extract("_l", CLASS_DECL, 1)
    meth = F.regexp_extract("_l", METHOD_DECL, 1)
    decl = lines.select(*keys, "line", F.when(cls != "", F.lit("class")).when(
        (meth != "") & ~meth.isin("if", "for", "while", "switch", "catch", "return", "new", "synchronized"),
        F.lit("method")).alias("kind"), F.when(cls != "", cls).otherwise(meth).alias("name")) \
        .filter(F.col("kind").isNotNull())
    w = Window.partitionBy(*keys).orderBy("line")
    nxt = F.lead("line").over(w)
    return decl.join(last, keys).select(
        *keys, "kind", "name", F.col("line").alias("start_line"),
        F.when(F.col("kind") == "class", F.col("_last"))
        .otherwise(F.coalesce(nxt - 1, F.col("_last"))).alias("end_line"))
