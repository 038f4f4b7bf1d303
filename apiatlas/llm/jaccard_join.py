"""N-gram Jaccard join by multiple-global-order filtering.

A document's set holds its distinct five-word shingles (64-bit hashes). Two sets of
Jaccard similarity 0.75 or more share a token within the first ``n - ceil(0.75 n) + 1``
tokens of each under *any* one order of all tokens. Here the orders put rare tokens first:
a sketch counts every token of every document in a fixed number of counters, one row of
counters per order, and tokens are sorted by (count, hash) with another hash in each
order. Orders only decide how much work there is, never which links are found.

1. One pass over the texts gives each document's set size and digest and the sketch.
2. A second pass emits each document's prefix under the first order; exact copies are left
   out as early as their task. Tokens that one document alone holds fall away, and lists
   with the same members are kept once.
3. A document that shares enough tokens with the leader of most of its lists is compared
   with it; links join documents into components. Then all pairs of a list whose components
   still differ are counted, and those that share enough prefix tokens to be similar are
   compared. So no link between different texts is lost, while a large group of copies
   costs one comparison a member instead of one a pair. A pair of near copies shares many
   lists; it is met in the first of them only.
4. Before two sets are compared, the pair must share a prefix token under every one of the
   orders; then the overlap is counted from the whole texts.

Cases: null or empty texts (or texts without words) have an empty set and link with
nothing; texts of fewer than five words have one shingle, the whole sequence; repeated
rows and equal texts fall in one component; rows that share a doc_id but not the text count
as one document, and which pairs are compared is judged by its largest text's size (a
doc_id should name one text); rows with a null doc_id get their set size, a null component
and link with nothing; an empty table gives no rows; other columns are not carried, but
``keep_one_each`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apiatlas.llm.common import WordHashes, fresh, mix64, release, ship, window_hashes
from apiatlas.llm.components import connected_components
from apiatlas.session import write_table

ship(__name__)

WIDTH = 5
#: Similarity 0.75 as a ratio of whole numbers: 100 * common >= 75 * union.
NUM, DEN = 75, 100
#: One seed per token order.
ORDERS = (11, 23, 47)
#: Counters of the token sketch, as a power of two; fixed, whatever the input.
SKETCH_BITS = 20
#: Sketch counters travel in pieces of this many.
PIECE = 1 << 14
#: Rows that one task may hold of a token's list: more frequent tokens are salted.
LIST_SPLIT = 20_000
#: A pair that meets in lists of so many members is taken from the first of them that both hold,
#: as far as a document's ``LOOK_BACK`` lists before each one tell.
LONG_LIST, LOOK_BACK = 8, 64
#: Digests by which a task leaves out copies; beyond them it starts anew and emits more.
REMEMBER = 100_000
#: Bits, as a power of two, of the bitmap of ids whose texts are compared (2 MB in all).
ID_BITS = 24


def shingles(text: bytes | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a text (A-Z lower-cased, ASCII white space between words)."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    own = hashes.of(words)
    return np.unique(window_hashes(own, min(WIDTH, len(words))))


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def counter_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def prefix(tokens: np.ndarray, levels: np.ndarray, seed: int) -> np.ndarray:
    """The first tokens of a set in one order: by the sketch's level, then by a hash."""
    p = prefix_length(len(tokens))
    h = mix64(tokens + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    key = (levels[counter_of(tokens)].astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
    first = np.argpartition(key, p - 1)[:p] if p < len(tokens) else np.arange(len(tokens))
    return tokens[first[np.argsort(key[first])]]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sets without repeats."""
    both = np.sort(np.concatenate([a, b]))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def similar(a: np.ndarray, b: np.ndarray, levels: np.ndarray) -> bool:
    """Length filter, then every order's prefix filter, then the exact overlap."""
    small, large = sorted((len(a), len(b)))
    if not small or DEN * small < NUM * large:
        return False
    if not all(common(prefix(a, levels, seed), prefix(b, levels, seed)) for seed in ORDERS):
        return False
    same = common(a, b)
    return DEN * same >= NUM * (small + large - same)


def _scan(ids_and_texts: DataFrame) -> DataFrame:
    """Per document (doc_id, n, digest); per task the pieces of its sketch."""
    names = ["doc_id", "n", "digest", "piece", "counters"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            sizes, digests, seen = [], [], []
            for k, text in enumerate(batch.column(1), 1):
                own = shingles(text.as_py(), hashes)
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                seen.append(counter_of(own))
                if k % 500 == 0 or k == len(batch):
                    np.add.at(sketch, np.concatenate(seen), np.uint32(1))
                    seen.clear()
            n = len(sizes)
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                                   pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        pieces = sketch.astype(np.int64).reshape(-1, PIECE)
        used = [k for k in range(len(pieces)) if pieces[k].any()]
        for at in range(0, len(used), 16):
            part = used[at:at + 16]
            yield pa.record_batch([pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.int64()), pa.nulls(len(part), pa.binary()),
                                   pa.array(part, pa.int32()), pa.array([pieces[k].tobytes() for k in part], pa.binary())], names=names)
        hashes = sketch = pieces = None
        release()

    return ids_and_texts.mapInArrow(scan, "doc_id long, n long, digest binary, piece int, counters binary")


def _sum_pieces(pieces: DataFrame, *keys: str) -> DataFrame:
    """Sum sketch pieces, one addition after the other: a group's size costs time, not memory."""

    def add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PIECE, np.int64)
        for t in tables:
            for c in t.column("counters"):
                total += np.frombuffer(c.as_buffer(), np.int64)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                              names=["piece", "counters"])

    return pieces.groupBy(*keys).applyInArrow(add, "piece int, counters binary")


def _levels(scan: DataFrame) -> tuple[np.ndarray, float]:
    """One byte a counter, a fixed number of bytes in all: 0 for counts that tokens of single
    documents explain, above that steps of a quarter of a doubling."""
    pieces = (scan.filter("piece IS NOT NULL").select("piece", "counters")
              .withColumn("salt", F.pmod(F.xxhash64("counters"), F.lit(16))))
    total = np.zeros(((1 << SKETCH_BITS) // PIECE, PIECE), np.int64)
    for row in _sum_pieces(_sum_pieces(pieces, "piece", "salt"), "piece").collect():  # a fixed number of rows
        total[row["piece"]] = np.frombuffer(row["counters"], np.int64)
    total = total.reshape(-1)
    middle = float(np.median(total))
    usual = middle + 4 * middle ** 0.5 + 4
    steps = 1 + np.floor(4 * np.log2(np.maximum(total, usual) / usual))
    return np.where(total > usual, np.minimum(255, steps), 0).astype(np.uint8), usual


def _index(ids_and_texts: DataFrame, levels, usual: float) -> DataFrame:
    """(token, salt, doc, pos) of every prefix in the first order, pos being the token's place
    in it. Copies within one task are left out: their class is known by its digest. salt is 0
    but for frequent tokens."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        level = levels.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids, tokens, salts, places = [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    own = shingles(text.as_py(), hashes)
                    digest = xxhash.xxh3_128_digest(own.tobytes())
                    if not len(own) or digest in seen:
                        continue
                    if len(seen) >= REMEMBER:
                        seen.clear()
                    seen.add(digest)
                    first = prefix(own, level, ORDERS[0])
                    tokens.append(first)
                    places.append(np.arange(len(first), dtype=np.int32))
                    ids.append(np.full(len(first), doc, np.int64))
                    own_level = level[counter_of(first)]
                    split = np.where(own_level > 0, usual * 2.0 ** (own_level / 4) // LIST_SPLIT, 0).astype(np.int64)
                    salts.append(np.where(split > 1, 1 + xxhash.xxh32_intdigest(str(doc)) % np.maximum(split, 1), 0))
                if ids:
                    yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(salts).astype(np.int32)),
                                           pa.array(np.concatenate(ids)), pa.array(np.concatenate(places))],
                                          names=["token", "salt", "doc", "pos"])
        hashes = seen = batch = part = None
        release()

    return ids_and_texts.mapInArrow(index, "token long, salt int, doc long, pos int")


def _lists(index: DataFrame) -> DataFrame:
    """(list, doc, weight, pos) of the tokens held by several documents, one list for all
    tokens with the same members: weight counts these tokens, pos is the first one's place."""
    w = Window.partitionBy("token", "salt")
    shared = (index.withColumns({"low": F.min("doc").over(w), "members": F.count("*").over(w),
                                 "mark": F.sum(F.xxhash64("doc") % F.lit(1 << 40)).over(w)})
              .filter("members > 1 OR salt > 0")
              .withColumn("list", F.when(F.col("salt") == 0, F.xxhash64("members", "mark", "low")).otherwise(F.col("token"))))
    return shared.groupBy("list", "doc").agg(F.count("*").alias("weight"), F.min("pos").alias("pos"))


def _leaders(members: DataFrame) -> DataFrame:
    """(u, v): each document and the leader of most of its lists, if they share enough
    tokens. A list's leader is the member that shares most tokens with others at all: the
    text that a group's near copies were made from rather than one of them."""
    sizes = members.groupBy("list").agg(F.count("*").alias("k"))
    known = write_table(members.join(sizes.filter("k > 1"), "list").groupBy("doc").agg(F.sum(F.col("weight") * F.col("k")).alias("degree")))
    lead = members.join(known, "doc").groupBy("list").agg(
        F.max_by(F.struct("doc", "n"), F.struct("degree", -F.col("doc"))).alias("lead"))
    met = members.join(write_table(lead), "list").filter("doc != lead.doc")
    return (met.groupBy("doc", F.col("lead.doc").alias("v")).agg(F.sum("weight").alias("c"), F.max("n").alias("na"), F.max("lead.n").alias("nb"))
            .filter(can_link("c", "na", "nb"))
            .groupBy(F.col("doc").alias("u")).agg(F.max_by("v", F.struct("c", -F.col("v"))).alias("v")))


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """``rows`` without most of those whose doc_id isn't among ``ids``: a bitmap of hashed ids,
    of a fixed number of bits, keeps texts that no pair needs out of the shuffles."""
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS)) + 1
    bitmap = write_table(ids.groupBy(F.bitmap_bucket_number(at).alias("part"))
                         .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.pmod(F.floor(byte / F.pow(F.lit(2), place % 8)), F.lit(2)) == 1
    return rows.join(F.broadcast(bitmap), (F.bitmap_bucket_number(at) == F.col("part")) & hit).select(*rows.columns)


def _verified(pairs: DataFrame, ids_and_texts: DataFrame, levels) -> DataFrame:
    """The pairs (u, v) whose texts are similar."""

    @F.arrow_udf("boolean")
    def check(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        hashes, level = WordHashes(), levels.value
        for left, right in batches:
            out, last, own = [], None, None
            for a, b in zip(left, right):
                a, b = a.as_py(), b.as_py()
                if b != last:  # the join leaves one leader's pairs next to each other
                    last, own = b, shingles(b, hashes)
                out.append(similar(shingles(a, hashes), own, level))
            yield pa.array(out, pa.bool_())
        hashes = own = left = right = None
        release()

    wanted = _only(ids_and_texts, pairs.select(F.explode(F.array("u", "v")).alias("doc_id")))
    one = wanted.toDF("u", "text_u")
    two = wanted.toDF("v", "text_v")
    return (pairs.join(one, "u").join(two, "v").filter(check("text_u", "text_v")).select("u", "v").distinct())


def rest_of(n: str) -> str:
    """SQL of the number of tokens behind the prefix of a set of ``n``."""
    return f"({n} - ({n} - (({NUM} * {n} + {DEN - 1}) div {DEN}) + 1))"


def can_link(c: str, a: str, b: str) -> str:
    """SQL of the bound: ``c`` shared prefix tokens, and behind the prefix that ends first at
    most its set's other tokens, allow enough overlap of sets of ``a`` and ``b`` tokens."""
    return (f"({DEN} * least({a}, {b}) >= {NUM} * greatest({a}, {b}) AND "
            f"{NUM + DEN} * ({c} + greatest({rest_of(a)}, {rest_of(b)})) >= {NUM} * ({a} + {b}))")


def _open_lists(members: DataFrame) -> DataFrame:
    """The rows of lists whose members are of several components; ``long`` tells long lists."""
    mixed = (members.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), (F.count("*") >= LONG_LIST).alias("long"))
             .filter("lo < hi").select("list", "long"))
    return write_table(members.join(mixed, "list"))


def _met(open_lists: DataFrame) -> DataFrame:
    """(u, v) of pairs of one list in different components that can still be similar, judged by
    the place of their first common token. In each list the members of its largest component are
    not compared with each other; the others meet all members.

    ``alone`` tells documents of one text: their lists follow each other in the order of all
    tokens. Two of them meet in the first long list that they share, not in each of them."""
    largest = (open_lists.groupBy("list", "comp").agg(F.count("*").alias("k"))
               .groupBy("list").agg(F.max_by("comp", F.struct("k", "comp")).alias("top")))
    # what a document shares with anyone: in the lists that begin before this one, and from this one on
    own = Window.partitionBy("doc")
    shares = open_lists.withColumn("before", F.coalesce(F.sum("weight").over(
        own.orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("on", F.sum("weight").over(own) - F.col("before"))
    back = F.collect_list(F.when(F.col("long"), F.col("list"))).over(own.orderBy("pos", "list").rowsBetween(-LOOK_BACK, -1))
    shares = (shares.withColumns({"earlier": back, "alone": F.min("alone").over(own)})
              .withColumn("earlier", F.when(F.col("long") & F.col("alone"), F.col("earlier")).otherwise(F.array().cast("array<bigint>"))))
    marked = shares.join(largest, "list").withColumn("inside", F.col("comp") == F.col("top"))
    a = marked.filter("NOT inside").selectExpr("list", "doc AS a", "comp AS ca", "n AS na", "n - pos AS ra", "before AS pa", "on AS oa",
                                               "alone AS xa", "earlier AS ea")
    b = marked.selectExpr("list", "doc AS b", "comp AS cb", "n AS nb", "n - pos AS rb", "before AS pb", "on AS ob",
                          "alone AS xb", "earlier AS eb", "inside")
    # the first token that a pair shares has all its other common tokens behind it, on both sides; no pair
    # shares more before a list (nothing before its first), and from it on, than either member shares there with anyone
    met = a.join(b, "list").filter(f"ca != cb AND (inside OR a < b) AND {NUM + DEN} * least(ra, rb) >= {NUM} * (na + nb) "
                                   f"AND {can_link('if(xa AND xb, 0, least(pa, pb)) + least(oa, ob)', 'na', 'nb')} AND NOT arrays_overlap(ea, eb)")
    return met.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def _cross_pairs(members: DataFrame) -> DataFrame:
    """Pairs that meet in a list and share enough prefix tokens to be similar: all that they
    share are counted, whichever lists they stand in."""
    open_lists = _open_lists(members)
    candidates = _met(open_lists).distinct()
    tokens = write_table(open_lists.groupBy("doc").agg(F.max("n").alias("n"), F.flatten(F.collect_list(F.transform(
        F.sequence(F.lit(1), F.col("weight")), lambda k: F.xxhash64("list", k)))).alias("tokens")))
    both = candidates.join(tokens.toDF("u", "na", "ta"), "u").join(tokens.toDF("v", "nb", "tb"), "v")
    return both.withColumn("c", F.size(F.array_intersect("ta", "tb"))).filter(can_link("c", "na", "nb")).select("u", "v")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``; component_id is
    the smallest doc_id reachable by links, itself included."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    scan = write_table(_scan(texts))
    level, usual = _levels(scan)
    levels = spark.sparkContext.broadcast(level)
    named = texts.filter("doc_id IS NOT NULL")
    sizes = scan.filter("piece IS NULL").select("doc_id", "n", "digest")

    # equal sets: one class, named by its smallest doc_id
    held = sizes.filter("n > 0 AND doc_id IS NOT NULL")
    firsts = write_table(held.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("k")).filter("k > 1"))
    stars = write_table(held.join(firsts, "digest").filter("doc_id != rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    size = held.groupBy(F.col("doc_id").alias("doc")).agg(F.max("n").alias("n"), (F.min("digest") == F.max("digest")).alias("alone"))
    rep = write_table(stars.groupBy(F.col("u").alias("member")).agg(F.min("v").alias("rep"))
                      .join(size.select(F.col("doc").alias("member"), F.col("alone").alias("sole")), "member"))

    lists = _lists(_index(named, levels, usual)).join(rep, F.col("doc") == F.col("member"), "left")
    members = write_table(lists.groupBy("list", F.coalesce("rep", "doc").alias("doc"))
                          .agg(F.max("weight").alias("weight"), F.min("pos").alias("pos"), F.coalesce(F.min("sole"), F.lit(True)).alias("sole"))
                          .join(size, "doc").withColumn("alone", F.col("alone") & F.col("sole")).drop("sole"))
    first = write_table(_leaders(members).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    comps = write_table(connected_components(stars.union(_verified(first, named, levels))))

    # what is left of each list: pairs of different components that weren't compared yet
    members = write_table(members.join(comps, F.col("doc") == F.col("node"), "left").select(
        "list", "doc", "weight", "pos", "n", "alone", F.coalesce("component", "doc").alias("comp")))
    second = write_table(_cross_pairs(members).join(first, ["u", "v"], "left_anti"))
    more = write_table(_verified(second, named, levels))
    if not more.isEmpty():
        comps = connected_components(comps.toDF("u", "v").union(more))
    return sizes.join(comps, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without all but one document of each component: the row of its smallest
    doc_id (of several such rows the one whose text hashes lowest). Rows with a null doc_id stay."""
    found = write_table(near_duplicates(docs, doc_id, text).filter("doc_id != component_id").select("doc_id").distinct())
    key, rank = fresh(docs, "__key", "__rank")
    left = docs.filter(F.col(doc_id).isNotNull()).join(
        found.withColumnRenamed("doc_id", key), F.col(doc_id) == F.col(key), "left_anti")
    first = Window.partitionBy(doc_id).orderBy(F.xxhash64(text))
    return (left.withColumn(rank, F.row_number().over(first)).filter(F.col(rank) == 1).drop(rank)
            .unionByName(docs.filter(F.col(doc_id).isNull())))
