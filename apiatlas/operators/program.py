"""Facts of source files and the values that follow from them.

One narrow pass over the files (``functions.linearise``) gives expressions, definitions, returns
and blocks as rows; everything that needs more than one place of a file, or more than one
file, is a join: names meet definitions, parameters meet arguments, calls meet returns
(``resolve_values``), objects that are handed on meet the events of the callee (``call_paths``).

Identity follows names and scopes: a local is named by file, class, method and name, a field by
class and name, a method by class, name and number of parameters. A call on something whose
class the text does not tell meets no method.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiatlas.functions import encoding as enc
from apiatlas.functions import linearise as lin
from apiatlas.operators import jsonmodel, resolve
from apiatlas.operators import urls as U
from apiatlas.session import write_large

cloudpickle.register_pickle_by_value(sys.modules[lin.__name__])
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PACKAGE = r"(?m)^\s*package\s+([\w.]+)\s*;"
FIELDS = ["kind", "cls", "method", "line", "pos", "id", "what", "role", "name", "value", "scope", "root", "args", "type", "end_line", "depth",
          "root_what", "root_name", "root_value", "root_type"]
FACTS = ("project string, package string, path string, kind string, cls string, method string, line int, pos int, id int, what string, "
         "role string, name string, value string, scope int, root int, args array<int>, type string, end_line int, depth int, "
         "root_what string, root_name string, root_value string, root_type string")
#: Files of a batch of facts.
SLICE = 64
# fixed values: object types whose events are replayed, and the URL builder's calls
STRING_BUILDERS = ("StringBuilder", "StringBuffer")
JSON_TYPES = ("JSONObject", "JSONArray")
URL_BUILDER, URL_TYPE, REQUEST_BUILDER = "HttpUrl.Builder", "HttpUrl", "Request.Builder"
URL_STEPS = ("scheme", "host", "port", "parse", "addPathSegment", "addPathSegments", "addEncodedPathSegment", "addEncodedPathSegments",
             "fragment", "encodedFragment", "addQueryParameter", "addEncodedQueryParameter")


def source_facts(corpus: DataFrame) -> DataFrame:
    """All facts of ``corpus(project, path, content)``, one row each (schema ``FACTS``; the kinds
    are described in ``functions.linearise``). A narrow job; null and empty texts give no rows."""

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = [{"project": project, "package": package, "path": path, **dict.fromkeys(FIELDS), **row}
                        for project, package, path, text in zip(*(part.column(k).to_pylist() for k in range(4)))
                        for row in lin.linearise(text)]
                schema = schema or pa.schema([(n, pa.list_(pa.int32()) if n == "args" else pa.int32() if n in whole else pa.string())
                                              for n in ("project", "package", "path", *FIELDS)])
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    whole = ("line", "pos", "id", "scope", "root", "end_line", "depth")
    package = F.nullif(F.regexp_extract("content", PACKAGE, 1), F.lit(""))
    return corpus.select("project", package.alias("package"), "path", F.col("content").cast("string")).mapInArrow(facts, FACTS)


def key_of(number: Column | str) -> Column:
    """An expression's id across files."""
    return F.concat(F.col("path"), F.lit("#"), (F.col(number) if isinstance(number, str) else number).cast("string"))


def simple(type_: Column) -> Column:
    """A type's name as its users write it: without packages and array marks."""
    return F.regexp_extract(type_, r"((?:[A-Z]\w*\.)*\w+)(?:\[\])*$", 1)


def variable(name: Column, qualifier: Column, type_: Column) -> Column:
    """The identity of the variable that a name stands for, by file, class and method of the row:
    a local or parameter if its type is known, else a field of the class or of ``qualifier``."""
    own = F.when(qualifier.isNull() | (qualifier == "this"), F.col("cls")).when(qualifier.rlike(r"^[A-Z]\w*$"), qualifier)
    local = F.concat_ws("|", F.lit("L"), "path", F.concat_ws(".", "cls", "method"), name)
    return F.when(type_.isNotNull() & qualifier.isNull(), local).when(own.isNotNull(), F.concat_ws("|", F.lit("F"), own, name))


def method_key(cls: Column, name: Column) -> Column:
    return F.when(cls.isNotNull(), F.concat(cls, F.lit("."), name))


class Program:
    """The facts of a corpus, written once, and the tables that are read off them."""

    def __init__(self, corpus: DataFrame):
        self.facts = write_large(source_facts(corpus))
        e = self.facts.filter("kind = 'expr'")
        null = F.lit(None).cast("string")
        self.exprs = e.withColumn("expr_id", key_of("id"))
        d = self.facts.filter("kind = 'def'")
        local = F.col("what").isin("local", "param")
        var = variable(F.col("name"), F.when(~local & (F.col("what") != "field"), F.col("value")), F.when(local, F.coalesce("type", F.lit(""))))
        self.defs = d.withColumn("var", var).withColumn("expr_id", F.when(F.col("id").isNotNull(), key_of("id")))
        self.names = self.exprs.filter("what = 'name' AND name NOT IN ('this', 'super')").withColumn(
            "var", variable(F.col("name"), F.col("value"), F.col("type")))
        calls = self.exprs.filter("what = 'call'")
        # a receiver that is a field of its own class: the field's declared type
        fields = self.defs.filter("what = 'field'").groupBy("project", "var").agg(F.min("type").alias("field_type"))
        calls = calls.withColumn("root_var", F.when(F.col("root_what") == "name", variable(F.col("root_name"), F.col("root_value"), F.col("root_type"))))
        calls = calls.join(fields.withColumnRenamed("var", "root_var"), ["project", "root_var"], "left")
        direct = F.col("scope") == F.col("root")
        cls = F.coalesce(F.col("value"), F.when(direct, F.col("field_type")))
        self.calls = write_large(calls.withColumn("object_type", simple(F.coalesce("root_type", "field_type"))).withColumn(
            "callee", method_key(simple(cls), F.concat("name", F.lit("/"), F.size("args").cast("string")))).drop("field_type")
            .withColumn("chain", key_of("root")))
        made = self.exprs.filter("what = 'new'").select(
            "project", "path", "cls", "method", "id", "expr_id", "args",
            method_key(simple(F.col("name")), F.concat(F.regexp_extract("name", r"(\w+)$", 1), F.lit("/"), F.size("args").cast("string"))).alias("callee"))
        called = self.calls.filter("callee IS NOT NULL").select("project", "path", "cls", "method", "id", "expr_id", "args", "callee").unionByName(made)
        args = called.select("project", "path", "callee", F.col("id").alias("call"), F.col("cls").alias("caller_cls"), F.col("method").alias("caller_method"),
                             F.posexplode("args").alias("arg_pos", "arg"))
        what = self.exprs.select("project", "path", F.col("id").alias("arg"), F.col("what").alias("arg_what"), "name", "value", "type", "cls", "method")
        self.args = write_large(args.join(what, ["project", "path", "arg"]).withColumn(
            "arg_var", F.when(F.col("arg_what") == "name", variable(F.col("name"), F.col("value"), F.col("type")))).withColumn("expr_id", key_of("arg")))
        self.params = self.defs.filter("what = 'param'").select(
            "project", "path", method_key(F.col("cls"), F.col("method")).alias("callee"), F.col("args")[0].alias("arg_pos"), "name", "type",
            "var", F.col("value").alias("visibility"))
        self.null = null
        self._links = None

    def links(self) -> DataFrame:
        """links(project, use_id, def_id): names to values and arguments, calls to returned values."""
        if self._links is None:
            self._links = write_large(self._all_links())
        return self._links

    def _all_links(self) -> DataFrame:
        values = self.defs.filter("expr_id IS NOT NULL").select("project", "var", F.col("expr_id").alias("def_id"), "role", "what", "id", "path")
        literals = self.exprs.filter("what = 'literal' AND type = 'null'").select("project", F.col("expr_id").alias("def_id"))
        values = values.join(literals, ["project", "def_id"], "left_anti")
        named = self.names.select("project", "var", F.col("expr_id").alias("use_id"), F.col("value").alias("qualifier")).join(values, ["project", "var"])
        # through a class only the initialiser counts
        named = named.filter("qualifier IS NULL OR qualifier = 'this' OR role = 'init'").select("project", "use_id", "def_id")
        given = resolve.resolve_param(self.params, self.args.select(
            "project", "path", "callee", "arg_pos", "expr_id", F.when(F.col("arg_what") == "literal", "literal").when(
                F.col("arg_what") == "name", "name").otherwise("other").alias("arg_kind"),
            method_key(F.col("caller_cls"), F.col("caller_method")).alias("caller"), F.col("name").alias("arg_ref")))
        passed = given.join(self.params.select("project", "callee", "arg_pos", "var"), ["project", "callee", "arg_pos"]) \
            .join(self.names.select("project", "var", F.col("expr_id").alias("use_id")), ["project", "var"]) \
            .select("project", "use_id", F.col("expr_id").alias("def_id"))
        returns = self.facts.filter("kind = 'return'").select("project", method_key(F.col("cls"), F.col("method")).alias("callee"), key_of("id").alias("expr_id"))
        returned = resolve.resolve_return(self.calls.filter("callee IS NOT NULL"), returns) \
            .select("project", F.col("call_id").alias("use_id"), F.col("return_id").alias("def_id"))
        whole = self.calls.filter("name = 'toString' AND size(args) = 0 AND scope IS NOT NULL").select(
            "project", F.col("expr_id").alias("use_id"), key_of("scope").alias("def_id"))
        return named.unionByName(passed).unionByName(returned).unionByName(whole).distinct()

    def parts(self) -> DataFrame:
        """parts(project, expr_id, pos, part_id): operands of ``a + b`` and of ``a.concat(b)``."""
        plus = self.exprs.filter("what = 'concat'").select("project", "path", "expr_id", F.posexplode("args").alias("pos", "part"))
        concat = self._concat_calls().select("project", "path", "expr_id", F.posexplode(F.concat(F.array("scope"), F.slice("args", 1, 1))).alias("pos", "part"))
        return plus.unionByName(concat).select("project", "expr_id", "pos", key_of("part").alias("part_id")).hint("merge")

    def _concat_calls(self) -> DataFrame:
        return self.calls.filter("name = 'concat' AND size(args) = 1 AND scope IS NOT NULL")

    def values(self, more: DataFrame | None = None) -> DataFrame:
        """(project, expr_id, value) of all expressions, where ``more(project, expr_id, value)`` are known."""
        what = self.exprs.join(self._concat_calls().select("project", "expr_id", F.lit(True).alias("concat")), ["project", "expr_id"], "left")
        text = F.when(F.col("type") == "String", enc.unescape_java(F.col("value"))).otherwise(F.col("value"))
        kind = F.when(F.col("what") == "literal", "literal").when(F.col("concat") | (F.col("what") == "concat"), "concat").otherwise("ref")
        known = (F.col("what") == "literal") & (F.col("type") != "null")
        exprs = what.select("project", "expr_id", F.when((F.col("what") == "literal") & ~known, "ref").otherwise(kind).alias("kind"),
                            F.when(known, text).alias("value"), F.when((F.col("what") == "name") & ~F.endswith("type", F.lit("]")), simple(F.col("type"))).alias("declared_type"))
        if more is not None:
            ids = more.select("project", "expr_id").distinct()
            exprs = exprs.join(ids, ["project", "expr_id"], "left_anti").unionByName(more.select(
                "project", "expr_id", F.lit("literal").alias("kind"), "value", self.null.alias("declared_type")))
        return resolve.resolve_values(exprs, self.links(), self.parts())

    def passes(self) -> DataFrame:
        """passes(project, var, pos, callee_var): variables handed on as arguments."""
        return self.args.filter("arg_var IS NOT NULL").select("project", F.col("arg_var").alias("var"), F.col("call").alias("pos"), "callee", "arg_pos") \
            .join(self.params.select("project", "callee", "arg_pos", F.col("var").alias("callee_var")), ["project", "callee", "arg_pos"]) \
            .select("project", "var", "pos", "callee_var")

    def builder_texts(self, values: DataFrame) -> DataFrame:
        """(project, expr_id, value): what uses of String builders hold (R8): every append of the
        variable's object, in execution order, also those that callees make."""
        alts = values.groupBy("project", "expr_id").agg(F.array_sort(F.collect_set("value")).alias("alts"))
        appends = self.calls.filter((F.col("name") == "append") & F.col("object_type").isin(*STRING_BUILDERS) & (F.size("args") == 1)) \
            .select("project", F.col("root_var").alias("builder"), F.col("id").alias("pos"), key_of(F.col("args")[0]).alias("expr_id")) \
            .join(alts, ["project", "expr_id"], "left")
        known = appends.withColumn("alts", F.coalesce("alts", F.array().cast("array<string>")))
        # an append without a value drops the whole builder
        bad = resolve.events_of_roots(known.select("project", "builder", "pos", "alts"), self.passes(), "builder")
        bad = write_large(bad)
        lost = bad.filter(F.size("alts") == 0).select("project", "builder").distinct()
        folded = resolve.product_fold(bad.join(lost, ["project", "builder"], "left_anti"), ["project", "builder"], "pos", "alts")
        return self.names.join(folded.withColumnRenamed("builder", "var").withColumnRenamed("value", "text"), ["project", "var"]) \
            .select("project", "expr_id", F.col("text").alias("value"))

    def url_builders(self, values: DataFrame) -> DataFrame:
        """(project, path, builder, text): URLs of builder chains and builder variables."""
        alts = values.groupBy("project", "expr_id").agg(F.array_sort(F.collect_set("value")).alias("alts"))
        starts = (F.col("root_what") == "new") & (simple(F.col("root_name")) == URL_BUILDER) | (F.col("root_what") == "name") & (F.col("root_name") == URL_TYPE)
        of_var = F.col("object_type").isin(URL_BUILDER, URL_TYPE) & F.col("root_var").isNotNull()
        own = self.calls.filter(starts | of_var).withColumn("builder", F.when(of_var, F.col("root_var")).otherwise(F.col("chain")))
        # a chain that initialises a builder variable belongs to it, ahead of the variable's own steps
        held = self.defs.filter((simple(F.col("type")) == URL_BUILDER) & F.col("id").isNotNull()).select("project", "path", "id", "var") \
            .join(self.exprs.select("project", "path", "id", "root"), ["project", "path", "id"]) \
            .select("project", F.concat("path", F.lit("#"), F.col("root").cast("string")).alias("chain"), "var").distinct()
        own = own.join(held, ["project", "chain"], "left").withColumn("is_init", F.col("var").isNotNull() & (F.col("builder") == F.col("chain"))) \
            .withColumn("builder", F.when(F.col("is_init"), F.col("var")).otherwise(F.col("builder")))
        finished = own.filter("name = 'build'").select("project", "builder", F.lit(True).alias("built")).distinct()
        steps = own.filter(F.col("name").isin(*URL_STEPS)).join(finished, ["project", "builder"], "left").select(
            "project", "builder", (F.col("is_init") & F.col("built").isNull()).alias("is_init"),
            # what initialises a field stands ahead of its uses, wherever the file declares it
            F.when(F.col("is_init"), F.col("id") - (1 << 30)).otherwise(F.col("id")).alias("pos"), F.col("name").alias("step"), "path", "args")
        key = lambda n: F.when(F.size("args") > n, F.concat("path", F.lit("#"), F.get("args", F.lit(n)).cast("string")))
        steps = steps.withColumns({"expr_id": key(0), "second": key(1)}).join(alts, ["project", "expr_id"], "left") \
            .join(alts.toDF("project", "second", "alts2"), ["project", "second"], "left") \
            .select("project", "builder", "pos", "is_init", "step", "alts", "alts2", "path")
        steps = write_large(resolve.events_of_roots(steps, self.passes(), "builder"))
        # a step whose value nobody knows drops the builder's URL, and a path goes to the file that comes first
        two = F.col("step").isin("addQueryParameter", "addEncodedQueryParameter")
        lost = steps.filter(F.col("alts").isNull() | two & F.col("alts2").isNull()).select("project", "builder").distinct()
        files = steps.groupBy("project", "builder").agg(F.min("path").alias("path"))
        folded = U.fold_builder_steps(steps.join(lost, ["project", "builder"], "left_anti").withColumn("path", F.lit("")))
        return folded.drop("path").join(files, ["project", "builder"])

    def requests(self) -> DataFrame:
        """requests(project, request, pos, call, arg): calls on request builders in order; ``url`` names
        the builder of its URL variable, through the variable's value (U8)."""
        starts = (F.col("root_what") == "new") & (simple(F.col("root_name")) == REQUEST_BUILDER) | (F.col("object_type") == REQUEST_BUILDER)
        own = self.calls.filter(starts)
        held = self.defs.filter((simple(F.col("type")) == REQUEST_BUILDER) & F.col("id").isNotNull()).select("project", "path", "id", "var") \
            .join(self.exprs.select("project", "path", "id", "root"), ["project", "path", "id"]) \
            .select("project", F.concat("path", F.lit("#"), F.col("root").cast("string")).alias("chain"), "var").distinct()
        own = own.join(held, ["project", "chain"], "left").withColumn(
            "request", F.coalesce(F.when(F.col("object_type") == REQUEST_BUILDER, F.col("root_var")), "var", "chain"))
        arg = self.names.select("project", F.col("expr_id").alias("arg_id"), F.col("var").alias("arg"))
        return own.select("project", "request", F.col("id").alias("pos"), F.col("name").alias("call"),
                          F.when(F.size("args") == 1, F.concat("path", F.lit("#"), F.get("args", F.lit(0)).cast("string"))).alias("arg_id")) \
            .join(arg, ["project", "arg_id"], "left").select("project", "request", "pos", "call", "arg")

    def json_events(self, values: DataFrame) -> DataFrame:
        """Events of JSON object and array variables (J4, J4s, J5), ready for ``fold_nested_events``: creations,
        seeds from constructor texts, and puts in execution order, also those that callees make."""
        kinds = F.col("object_type").isin(*JSON_TYPES)
        # a call has the type that its method declares
        methods = self.facts.filter("kind = 'block' AND what = 'method'").groupBy("project", method_key(F.col("cls"), F.col("name")).alias("callee")) \
            .agg(F.min("type").alias("returns"))
        returned = self.calls.filter("callee IS NOT NULL").select("project", "expr_id", "callee").join(methods, ["project", "callee"]).drop("callee")
        typed = self.exprs.join(returned, ["project", "expr_id"], "left").select(
            "project", "expr_id", "what", "name", "value", F.coalesce("type", "returns").alias("type")).join(
            self.names.filter(simple(F.col("type")).isin(*JSON_TYPES)).select("project", "expr_id", F.col("var").alias("json_var")), ["project", "expr_id"], "left")
        fields = self.defs.filter((F.col("what") == "field") & simple(F.col("type")).isin(*JSON_TYPES)).select("project", F.col("var")).distinct()
        held = self.names.join(fields, ["project", "var"]).select("project", "expr_id", F.col("var").alias("field_var"))
        typed = typed.join(held, ["project", "expr_id"], "left").withColumn("target", F.coalesce("json_var", "field_var"))
        alt = lambda v, t: F.struct(v.cast("string").alias("value"), t.alias("value_type"))
        known = values.join(typed.select("project", "expr_id", F.when(F.col("type").isin("null"), "string").otherwise(
            F.lower(F.coalesce(simple(F.col("type")), F.lit("string")))).alias("value_type")), ["project", "expr_id"]).select(
                "project", "expr_id", alt(F.col("value"), F.col("value_type")).alias("alt"))
        null = typed.filter("what = 'literal' AND type = 'null'").select("project", "expr_id", alt(F.lit("null"), F.lit("string")).alias("alt"))
        other = typed.filter("target IS NOT NULL").select("project", "expr_id", alt(F.col("target"), F.lit("object")).alias("alt"))
        alts = write_large(known.unionByName(null).unionByName(other).groupBy("project", "expr_id").agg(F.array_sort(F.collect_set("alt")).alias("alts")))
        arg = lambda n: F.concat("path", F.lit("#"), F.get("args", F.lit(n)).cast("string"))
        puts = self.calls.filter(kinds & (F.col("name") == "put") & F.col("root_var").isNotNull() & F.size("args").isin(1, 2)).select(
            "project", F.col("root_var").alias("object"), F.col("id").alias("pos"), F.size("args").alias("n"),
            F.when(F.size("args") == 2, arg(0)).alias("key_id"), F.when(F.size("args") == 2, arg(1)).otherwise(arg(0)).alias("expr_id"))
        keys = values.select("project", F.col("expr_id").alias("key_id"), F.col("value").alias("key"))
        puts = puts.join(keys, ["project", "key_id"], "left").filter("n = 1 OR key IS NOT NULL").join(alts, ["project", "expr_id"], "left") \
            .select("project", "object", "pos", F.lit("put").alias("kind"), "key", "alts")
        made = self.defs.filter(F.col("id").isNotNull()).select("project", "path", "id", "var").join(
            self.exprs.filter((F.col("what") == "new") & simple(F.col("name")).isin(*JSON_TYPES)).select("project", "path", "id", "args"), ["project", "path", "id"])
        seeds = made.withColumn("expr_id", F.when(F.size("args") == 1, arg(0))).join(alts, ["project", "expr_id"], "left") \
            .withColumn("texts", F.filter("alts", lambda a: a["value_type"] == "string")).select(
                "project", F.col("var").alias("object"), F.col("id").alias("pos"), F.when(F.size("texts") > 0, "seed").otherwise("new").alias("kind"),
                F.lit(None).cast("string").alias("key"), F.when(F.size("texts") > 0, F.col("texts")).alias("alts"))
        empty = F.array().cast("array<struct<value:string,value_type:string>>")
        every = puts.unionByName(seeds).withColumn("alts", F.coalesce("alts", empty))
        return resolve.events_of_roots(every, self.passes(), "object")

    def url_variables(self) -> DataFrame:
        """(project, url_var, builder): URL variables and the builders or chains that make their values."""
        return self.defs.filter((simple(F.col("type")) == URL_TYPE) & F.col("id").isNotNull()).select("project", "path", "id", F.col("var").alias("url_var")) \
            .join(self.calls.select("project", "path", "id", F.when(F.col("object_type") == URL_BUILDER, F.col("root_var")).otherwise(
                F.col("chain")).alias("builder")), ["project", "path", "id"]).select("project", "url_var", "builder").distinct()


def source_candidates(program: Program) -> dict[str, DataFrame]:
    """URL and text candidates that no single literal holds:

    * ``urls(project, path, line, library, text, ord, verb)``: URL builders with the verbs of
      their requests (U7, U8) and URL constructors (U4), ready for the catalog;
    * ``texts(project, path, line, library, text, ord)``: values of concatenations and String
      builders (R6-R8), URLs or JSON texts, and documents of JSON objects (J4, J5)."""
    first = program.values()
    builders = write_large(program.builder_texts(first))
    values = write_large(program.values(builders))

    built = write_large(program.url_builders(values))
    named = built.join(program.url_variables(), ["project", "builder"]).select("project", F.col("url_var").alias("builder"), "path", "text")
    verbs = U.attach_http_method(program.requests(), named).select("project", F.col("builder").alias("url_var"), "verb").distinct() \
        .join(program.url_variables(), ["project", "url_var"]).select("project", "builder", "verb").distinct()
    order = lambda line, pos: F.struct("path", line.cast("int").alias("line"), pos.cast("int").alias("pos"))
    none = F.lit(0)
    ok = built.join(verbs, ["project", "builder"], "left").select(
        "project", "path", none.alias("line"), F.lit("OkHttp").alias("library"), "text", order(none, none).alias("ord"), "verb")

    made = program.exprs.filter("what = 'new' AND name IN ('URL', 'java.net.URL', 'URI') AND size(args) BETWEEN 1 AND 4")
    alts = values.groupBy("project", "expr_id").agg(F.array_sort(F.collect_set("value")).alias("alternatives"))
    parts = made.select("project", "path", F.col("expr_id").alias("url"), F.size("args").alias("n_args"), F.posexplode("args").alias("arg_pos", "arg")) \
        .withColumn("expr_id", key_of("arg")).join(alts, ["project", "expr_id"]) \
        .select("project", F.col("url").alias("expr_id"), "n_args", "arg_pos", "alternatives")
    where = program.exprs.select("project", "expr_id", "path", "line", "pos")
    urls = U.assemble_urls(parts).join(where, ["project", "expr_id"]).select(
        "project", "path", "line", F.lit("noLib.URL").alias("library"), "text", order(F.col("line"), F.col("pos")).alias("ord"),
        F.lit(None).cast("string").alias("verb"))

    # of nested concatenations only the outermost counts
    operands = program.parts().select("project", F.col("part_id").alias("expr_id")).distinct()
    outer = program.parts().select("project", "expr_id").distinct().join(operands, ["project", "expr_id"], "left_anti")
    call = program.calls.select("project", "expr_id", F.lit("noLib.ConcatString").alias("call"))
    plus = outer.join(values, ["project", "expr_id"]).join(call, ["project", "expr_id"], "left") \
        .select("project", "expr_id", "value", F.coalesce("call", F.lit("noLib.StringLiteralExpr")).alias("library"))
    held = builders.select("project", "expr_id", "value").withColumn("library", F.lit("noLib.StringBuilder"))
    texts = plus.unionByName(held).join(where, ["project", "expr_id"]).select(
        "project", "path", "line", "library", F.col("value").alias("text"), order(F.col("line"), F.col("pos")).alias("ord"))
    docs = jsonmodel.fold_nested_events(program.json_events(values)).filter("doc LIKE '{_%}'").select("project", F.col("object").alias("var"), "doc").distinct()
    first_def = program.defs.groupBy("project", "var").agg(F.min(F.struct("path", "line", "pos")).alias("at"))
    objects = docs.join(first_def, ["project", "var"]).select(
        "project", "at.path", "at.line", F.lit("org.json").alias("library"), F.col("doc").alias("text"), F.col("at").alias("ord"))
    objects = objects.withColumn("ord", order(F.col("line"), F.col("ord.pos")))
    return {"urls": ok.unionByName(urls), "texts": texts.unionByName(objects), "values": values}


# What some library calls return, by the type they are called on.
RESULT_TYPES = {("java.net.URL", "openConnection"): "java.net.URLConnection", ("com.koushikdutta.ion.Ion", "with"): "com.koushikdutta.ion.builder.LoadBuilder"}
IMPORT = r"(?m)^\s*import\s+([A-Za-z_][\w.]*(?:\.\*)?)\s*;"


def typed_calls(program: Program, corpus: DataFrame, known_types: list[str]) -> DataFrame:
    """P3 with types: ``call_site(project, path, line, pos, kind, name, scope, scope_type, result_type, args,
    arg_types)`` of calls, creations and casts, ``args`` being the arguments' numbers in the file.

    A receiver's or argument's type is its declaration's, the last one before it in the nearest enclosing
    block, else its class's field's; of a creation the created type; of a class its own name. Names get
    their package from the file's imports; one that only a wildcard import can hold is looked for among
    ``known_types``. ``arg_types`` has the types both as written and with packages. Unknown types are NULL."""
    every = F.regexp_extract_all("content", F.lit(IMPORT), F.lit(1))
    files = corpus.select("project", "path", F.filter(every, lambda i: ~F.endswith(i, F.lit("*"))).alias("single"),
                          F.transform(F.filter(every, lambda i: F.endswith(i, F.lit("*"))), lambda i: F.substring_index(i, ".*", 1)).alias("wild")).hint("merge")
    types = F.array(*[F.lit(t) for t in sorted({*known_types, *(t for t, _ in RESULT_TYPES)})])

    def full(t: Column) -> Column:
        head = F.substring_index(t, ".", 1)
        single = F.try_element_at(F.filter("single", lambda i: F.endswith(i, F.concat(F.lit("."), head))), F.lit(1))
        wild = F.try_element_at(F.filter(F.transform("wild", lambda p: F.concat(p, F.lit("."), t)), lambda c: F.array_contains(types, c)), F.lit(1))
        return F.coalesce(F.concat(single, F.substr(t, F.length(head) + 1)), wild, t)

    own_class = F.when((F.col("scope") == F.col("root")) & F.col("value").rlike("^[A-Z]"), F.col("value"))
    direct = F.col("scope") == F.col("root")
    calls = program.calls.select(
        "project", "path", "line", "id", "name", F.col("root_name").alias("scope_name"), "args",
        F.when(direct, F.coalesce("object_type", own_class)).alias("scope_type"), F.lit("call").alias("kind"), F.lit(None).cast("string").alias("made"))
    made = program.exprs.filter("what = 'new'").select(
        "project", "path", "line", "id", F.regexp_extract("name", r"(\w+)(?:\[\])*$", 1).alias("name"), F.lit(None).cast("string").alias("scope_name"), "args",
        F.lit(None).cast("string").alias("scope_type"), F.lit("creation").alias("kind"), F.col("name").alias("made"))
    fields = program.defs.filter("what = 'field'").groupBy("project", F.col("var").alias("arg_var")).agg(F.min("type").alias("field_type"))
    literal = F.when(F.col("type") == "String", F.lit("String")).otherwise(F.col("type"))
    args = program.exprs.filter("what IN ('call', 'new')").select("project", "path", "id", F.posexplode("args").alias("arg_pos", "arg"))
    what = program.exprs.select("project", "path", F.col("id").alias("arg"), "what", "name", "value", "type", "cls", "method")
    args = args.join(what, ["project", "path", "arg"]).withColumn("arg_var", F.when((F.col("what") == "name") & F.col("type").isNull(), variable(
        F.col("name"), F.col("value"), F.col("type")))).join(fields, ["project", "arg_var"], "left").join(files, ["project", "path"], "left")
    as_written = F.when(F.col("what") == "literal", literal).when(F.col("what") == "new", F.col("name")).when(F.col("what") == "name", F.coalesce("type", "field_type"))
    arg_types = args.withColumn("t", as_written).groupBy("project", "path", "id").agg(
        F.array_sort(F.array_union(F.collect_set("t"), F.collect_set(full(F.col("t"))))).alias("arg_types"))
    sites = calls.unionByName(made).join(files, ["project", "path"], "left").join(arg_types, ["project", "path", "id"], "left") \
        .withColumns({"scope_type": full(F.col("scope_type")), "made": full(F.col("made"))})
    result = F.create_map(*[x for (t, m), r in RESULT_TYPES.items() for x in (F.lit(f"{t} {m}"), F.lit(r))])
    sites = sites.withColumn("result_type", F.coalesce("made", F.try_element_at(result, F.concat_ws(" ", "scope_type", "name"))))
    cast = program.facts.filter("kind = 'cast'").select("project", "path", F.col("line").alias("cast_line"), "id", F.regexp_extract("name", r"(\w+)(?:\[\])*$", 1).alias("to"))
    casts = cast.join(sites, ["project", "path", "id"]).select(
        "project", "path", F.col("cast_line").alias("line"), "id", F.col("to").alias("name"), F.col("name").alias("scope_name"), F.array().cast("array<int>").alias("args"),
        F.col("result_type").alias("scope_type"), F.lit("cast").alias("kind"), F.lit(None).cast("string").alias("result_type"), F.lit(None).cast("array<string>").alias("arg_types"))
    return sites.select(*casts.columns).unionByName(casts).select(
        "project", "path", "line", F.col("id").alias("pos"), "kind", "name", F.col("scope_name").alias("scope"), "scope_type", "result_type", "args", "arg_types")


def extract_blocks(facts: DataFrame) -> DataFrame:
    """R12's blocks from ``source_facts``: ``(project, path, kind, name, start_line, end_line, depth,
    parent)``: classes and methods with the lines of their braces, nested to any depth."""
    b = facts.filter("kind = 'block'")
    return b.select("project", "path", F.col("what").alias("kind"), F.substring_index("name", "/", 1).alias("name"),
                    F.col("line").alias("start_line"), "end_line", "depth", F.coalesce("method", "cls").alias("parent"))
