"""Line dedup by overlapping three-line windows. Built-in functions only.

Every run of three consecutive non-blank lines of a document is hashed (two 64-bit hashes
of the lines as they stand). A window that occurs more than once keeps its first
occurrence, by doc_id and then by place; the lines of every later occurrence are covered,
overlapping covers merge, and the covered lines go. The first copy of every line stays
somewhere: what covers a line points to an equal line at an earlier place.

Lines are the text's pieces between line feeds; a line of ASCII white space alone is
blank, belongs to no window and stays. Documents with fewer than three non-blank lines
have no window and stay as they are.

Cases: null text stays null and empty text empty, both without windows; texts of any
length are read whole; rows that repeat both doc_id and text are the same document and
get the same cleaned text; rows with one doc_id and different texts are told apart by the
text; null doc_ids come last in the order; an empty table gives no rows; other columns
pass through, and an input column named like a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apiatlas.llm.common import WORD, fresh
from apiatlas.session import write_table

WINDOW = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def occurrences(texts: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, k, places, h1, h2): every window of every document; (d1, d2) is the
    text's digest, k the window's number, places its lines' numbers from 0."""
    indexed = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    full = texts.select("doc_id", "d1", "d2", F.filter(indexed, lambda s: F.rlike(s["x"], F.lit(WORD))).alias("full"))
    hashed = full.filter(F.size("full") >= WINDOW).select(
        "doc_id", "d1", "d2", F.transform("full", lambda s: s["i"]).alias("at"),
        F.transform("full", lambda s: F.xxhash64(s["x"])).alias("a"),
        F.transform("full", lambda s: F.xxhash64(F.lit(1), s["x"])).alias("b"))

    def run(c: str, k: Column) -> list[Column]:
        return [F.get(c, k + j) for j in range(WINDOW)]

    windows = F.transform(F.sequence(F.lit(0), F.size("at") - WINDOW), lambda k: F.struct(
        k.alias("k"), F.array(*run("at", k)).alias("places"),
        F.xxhash64(*run("a", k)).alias("h1"), F.xxhash64(*run("b", k)).alias("h2")))
    return hashed.select("doc_id", "d1", "d2", F.inline(windows))


def without_places(lines: Column, places: Column) -> Column:
    """``lines`` without those at the sorted ``places``: the stretches between them, joined."""
    ends = F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines)))
    return F.flatten(F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda j: F.slice(
        lines, F.get(ends, j - 1) + 2, F.get(ends, j) - F.get(ends, j - 1) - 1)))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the cleaned text and ``n_lines`` and ``n_removed`` (long)."""
    d1, d2 = F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))
    windows = write_table(occurrences(docs.filter(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), d1.alias("d1"), d2.alias("d2"))))
    place = F.struct(F.isnull("doc_id").alias("n"), "doc_id", "d1", "d2", "k")
    # rows that repeat a document repeat its places too: they are not later occurrences
    firsts = (windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
              .filter("first != last").select("h1", "h2", "first"))
    covered = (windows.join(firsts, ["h1", "h2"]).filter(place != F.col("first"))
               .groupBy("doc_id", "d1", "d2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("places")))).alias("places")))
    k1, k2, k3, places = fresh(docs, "__id", "__d1", "__d2", "__places")
    side = covered.toDF(k3, k1, k2, places)
    own = docs.withColumns({"n_lines": F.coalesce(F.size(lines_of(F.col(text))), F.lit(0)).cast("long")})
    joined = own.join(side, F.col(doc_id).eqNullSafe(F.col(k3)) & (d1 == F.col(k1)) & (d2 == F.col(k2)), "left")
    cleaned = F.when(F.col(places).isNull(), F.col(text)).otherwise(
        F.array_join(without_places(lines_of(F.col(text)), F.col(places)), "\n"))
    return joined.withColumns({text: cleaned, "n_removed": F.coalesce(F.size(places), F.lit(0)).cast("long")}).drop(k1, k2, k3, places)
