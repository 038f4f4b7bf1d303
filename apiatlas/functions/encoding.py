"""Percent-encoding and placeholder helpers as Spark column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters each URL component escapes when it is added through
# an HTTP URL builder (the public okhttp encode sets); '%' itself is always escaped.
PATH_SEGMENT_ESCAPES = ' "<>^`{}|/\\?#'
FRAGMENT_ESCAPES = ' "#<>\\^`{|}'
QUERY_COMPONENT_ESCAPES = ' !"#$&\'(),/:;<=>?@[]\\^`{|}~+'

# Type placeholders that stand for "value unknown, type known".
TYPE_PLACEHOLDERS = ["<STRING>", "<DOUBLE>", "<FLOAT>", "<INTEGER>", "<BOOLEAN>"]

# Sample values that fill placeholders (both spellings).
PLACEHOLDER_SAMPLES = [
    ("<String>", "A"), ("<Double>", "0.0"), ("<Float>", "0.0"), ("<Integer>", "0"), ("<Boolean>", "true"),
    ("<STRING>", "A"), ("<DOUBLE>", "0.0"), ("<FLOAT>", "0.0"), ("<INTEGER>", "0"), ("<BOOLEAN>", "true"),
]


def percent_encode(col: Column, escapes: str) -> Column:
    """Escape '%' and every character of ``escapes`` as ``%XX`` (ASCII only)."""
    out = F.replace(col, F.lit("%"), F.lit("%25"))
    for ch in escapes:
        out = F.replace(out, F.lit(ch), F.lit("%{:02X}".format(ord(ch))))
    return out


def encode_path_segment(col: Column) -> Column:
    return percent_encode(col, PATH_SEGMENT_ESCAPES)


def encode_path_segments(col: Column) -> Column:
    """Several segments separated by '/': each one is escaped, the slashes stay."""
    return F.array_join(F.transform(F.split(col, "/"), encode_path_segment), "/")


def encode_fragment(col: Column) -> Column:
    return percent_encode(col, FRAGMENT_ESCAPES)


def encode_query_component(col: Column) -> Column:
    return percent_encode(col, QUERY_COMPONENT_ESCAPES)


def fill_placeholders(col: Column) -> Column:
    """Replace every type placeholder by its sample value (job G1)."""
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), PLACEHOLDER_SAMPLES, col)


def unescape_java(col: Column) -> Column:
    """Undo source-code escapes in this order: \\" -> ", \\' -> ', \\\\ -> \\ (J0)."""
    out = F.replace(col, F.lit('\\"'), F.lit('"'))
    out = F.replace(out, F.lit("\\'"), F.lit("'"))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def first_amp_to_question(col: Column) -> Column:
    """Turn the first '&' into '?' (unconditional)."""
    i = F.instr(col, "&")
    return F.when(i > 0, F.concat(F.substring_index(col, "&", 1), F.lit("?"),
                                  col.substr(i + 1, F.lit(1 << 30)))).otherwise(col)


def amp_to_question_if_no_query(col: Column) -> Column:
    """Turn the first '&' into '?' when it comes before any '?'."""
    amp, q = F.instr(col, "&"), F.instr(col, "?")
    return F.when((amp > 0) & ((q == 0) | (amp < q)), first_amp_to_question(col)).otherwise(col)
