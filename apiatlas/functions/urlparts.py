"""Column expressions that take a URL-like string apart (job U1).

All of them are plain Spark SQL expressions, so they stay inside whole-stage
codegen; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted scheme prefixes (case-sensitive) and the scheme that a
# leading "www." stands for.
HTTPS, HTTP, WS, WSS = "https://", "http://", "ws://", "wss://"
WWW = "www."


def java_split(s: Column, sep: str) -> Column:
    """``String.split(sep)`` for a one-character literal separator.

    Java keeps the whole input when the separator does not occur, drops
    trailing empty strings otherwise, and returns an empty array when only
    empty strings remain. Spark's ``split`` keeps trailing empties.
    """
    stripped = F.regexp_replace(s, "[" + sep + "]+$", "")
    return (F.when(~s.contains(sep), F.array(s))
            .when(stripped == "", F.array().cast("array<string>"))
            .otherwise(F.split(stripped, "[" + sep + "]")))


def url_scheme(t: Column) -> Column:
    return (F.when(t.startswith(HTTPS), F.lit(HTTPS))
            .when(t.startswith(WWW) | t.startswith(HTTP), F.lit(HTTP))
            .when(t.startswith(WS), F.lit(WS))
            .when(t.startswith(WSS), F.lit(WSS)))


def url_rest(t: Column, scheme: Column) -> Column:
    """Text after the scheme; a ``www.`` URL keeps its prefix in the authority."""
    return F.when(t.startswith(WWW), t).otherwise(t.substr(F.length(scheme) + 1, F.lit(1 << 30)))


def url_authority(rest: Column) -> Column:
    return F.regexp_extract(rest, r"^([^/?#]*)", 1)


def url_remainder(rest: Column, authority: Column) -> Column:
    """What follows the authority, without the one slash that separates them."""
    after = rest.substr(F.length(authority) + 1, F.lit(1 << 30))
    return F.when(after.startswith("/"), after.substr(2, 1 << 30)).otherwise(after)


def endpoint_head(remainder: Column) -> Column:
    return F.regexp_extract(remainder, r"^([^?#]*)", 1)


def strip_one_slash(path: Column) -> Column:
    return F.when(path.endswith("/"), path.substr(F.lit(1), F.length(path) - 1)).otherwise(path)


def query_entries(tail: Column) -> Column:
    """``?k=v&...`` tail -> array<struct<key,value>>, duplicate keys: last one wins.

    A pair is kept when Java's ``split("=")`` gives exactly two parts:
    ``a=`` and ``a=b=c`` drop, ``=b`` keeps an empty key, ``a=b=`` keeps ``b``.
    """
    qs = tail.substr(2, 1 << 30)
    qpart = F.regexp_extract(qs, r"^([^#]*)", 1)
    pairs = F.transform(F.split(qpart, "&"),
                        lambda p: F.split(F.regexp_replace(p, "=+$", ""), "="))
    kept = F.filter(pairs, lambda kv: F.size(kv) == 2)
    entries = F.transform(kept, lambda kv: F.struct(kv[0].alias("key"), kv[1].alias("value")))
    # keep an entry only if no later entry carries the same key
    dedup = F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.when(tail.startswith("?"), dedup).otherwise(
        F.array().cast("array<struct<key:string,value:string>>"))


def fragment_list(tail: Column) -> Column:
    """Fragments of a ``?query#f#g`` or ``#f#g`` tail (set semantics, sorted)."""
    qs = tail.substr(2, 1 << 30)
    after_hash = F.regexp_extract(qs, r"^[^#]*#(.*)$", 1)
    has_q_frag = qs.contains("#") & after_hash.rlike("[^#]")
    frags = (F.when(tail.startswith("?") & has_q_frag, java_split(after_hash, "#"))
             .when(tail.startswith("#"), java_split(qs, "#")))
    return F.coalesce(F.array_sort(F.array_distinct(frags)), F.array().cast("array<string>"))
