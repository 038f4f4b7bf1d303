"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.
Built-in functions only.

Each source's documents form a stream in the order of a seeded hash, cut into blocks of equal
length (a small target has shorter blocks, a part of it). A target that holds the stream once
or more takes all its blocks as often; of what is left, so many blocks are drawn at random as
hold it, the last one cut where the target ends. The source's quota is the number of blocks
drawn, and a document's words are taken as far as it lies in them. The tree's root holds all
quotas and all output shards; each node halves its shards and draws which part of each quota
goes left, exactly as if its blocks had been shuffled (a multivariate hypergeometric draw:
source by source, given what is left). A leaf is one shard with an exact quota of each source.
Along the way each quota keeps its range of the source's permuted draws, so shards draw
disjoint blocks; a document goes to the shard of its first block drawn, and within a shard
documents lie in hash order. Everything follows from the seed: reruns agree.

Weights repeat over the sources in code-point order, null last. Targets are shares of the
total size by weight; a target stops at ``repeats`` times its source's size and the excess
is shared again by weight until none is above.

Cases: null and empty texts have size 0 and are never drawn; a null source is a source of
its own; sources without words get target 0; repeated rows are documents of their own; of one
huge document the words in drawn blocks are taken (``mixed_documents`` takes a document whole if
that is most of it, else leaves it); an empty table gives no rows; other
columns pass through, and input columns named like a result are replaced. A node's row
holds one number a source: sources may be many thousands, documents any number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from apiatlas.llm.common import word_count
from apiatlas.session import write_table

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Words of a block, at most one part in so many of a target, and blocks of an output shard.
BLOCK_WORDS = 1 << 14
PARTS = 256
SHARD_BLOCKS = 64
SLICES = 16
SEED = 20
#: Cells of a source's hash range: the stream's places are summed cell by cell.
CELL_BITS = 16
#: Documents of one running sum, about.
BUCKET = 256
#: A prime: multiplying by it permutes the block numbers of every quota below it.
STEP = 2147483647
#: Result columns of draw_mix.
DRAWS = ("size", "source_size", "target", "shard", "words", "spot", "row")
ENTRIES = "array<struct<sid:bigint,first:bigint,q:bigint>>"


def _log_factorial(x: str) -> str:
    """ln(x!) by Stirling's series, eight places further up where it is exact to 1e-12."""
    up = "*".join(f"({x}+{i}D)" for i in range(1, 9))
    w = f"({x}+9D)"
    return f"(({w}-0.5D)*ln({w})-{w}+0.9189385332046727D+1D/(12D*{w})-1D/(360D*pow({w},3))-ln({up}))"


def _hypergeometric(total: str, good: str, drawn: str, u: str) -> str:
    """SQL of a hypergeometric draw by inversion of the uniform ``u``: probabilities are
    taken off outwards from the mode, twelve standard deviations to each side."""
    N, K, n = total, good, drawn
    lo, hi = f"greatest(0L,{n}+{K}-{N})", f"least({n},{K})"
    mode = f"cast(least({hi},greatest({lo},floor(({n}+1D)*({K}+1D)/({N}+2D)))) as bigint)"
    sd = f"sqrt(1D*{n}*{K}/{N}*({N}-{K})/{N}*({N}-{n})/greatest(1L,{N}-1L))"
    f = _log_factorial
    p = f"exp({f(K)}+{f(f'({N}-{K})')}+{f(n)}+{f(f'({N}-{n})')}-{f(N)}-{f('m')}-{f(f'({K}-m)')}-{f(f'({n}-m)')}-{f(f'({N}-{K}-{n}+m)')})"
    walk = f"""aggregate(sequence(1, cast(least({hi}-{lo}, ceil(12*{sd})+20) as int)),
        named_struct('u', {u}-p, 'got', if({u} < p, m, -1L), 'a', m, 'pa', p, 'b', m, 'pb', p),
        (s, i) -> if(s.got >= 0, s, transform(array(named_struct(
            'pa', if(s.a < {hi}, s.pa*({K}-s.a)/(s.a+1D)*({n}-s.a)/({N}-{K}-{n}+s.a+1D), 0D),
            'pb', if(s.b > {lo}, s.pb*s.b/({K}-s.b+1D)*({N}-{K}-{n}+s.b)/({n}-s.b+1D), 0D))),
            t -> named_struct('u', s.u-t.pa-t.pb,
                'got', if(s.u < t.pa, s.a+1L, if(s.u < t.pa+t.pb, s.b-1L, -1L)),
                'a', s.a+1L, 'pa', t.pa, 'b', s.b-1L, 'pb', t.pb))[0]),
        s -> if(s.got >= 0, s.got, m))"""
    return f"if({lo} >= {hi}, {lo}, transform(array({mode}), m -> transform(array({p}), p -> {walk})[0])[0])"


def _split(seed: int) -> str:
    """SQL of a node's left entries: every quota's part that goes to the left shards."""
    u = f"((pmod(xxhash64({seed}L, lo, hi, e.sid), 9007199254740992L)+0.5D)/9007199254740992D)"
    draw = _hypergeometric("st.rest", "e.q", "st.draw", u)
    return f"""aggregate(entries, named_struct('out', cast(array() as {ENTRIES}), 'rest', total, 'draw', goes),
        (st, e) -> transform(array({draw}), x -> named_struct(
            'out', concat(st.out, array(named_struct('sid', e.sid, 'first', e.first, 'q', x))),
            'rest', st.rest-e.q, 'draw', st.draw-x))[0], st -> st.out)"""


def splitting_tree(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, sid, first, q) from (sid, q): shard takes the ``q`` permuted blocks of source
    ``sid`` from number ``first`` on. Quotas are kept exactly; shards differ by one block."""
    entry = F.struct("sid", F.lit(0).cast("long").alias("first"), "q")
    nodes = quotas.filter("q > 0").agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.sum("q").alias("total")) \
        .filter("total > 0").selectExpr("0L AS lo", f"{shards}L AS hi", "total", "entries")
    for level in range(max(0, (shards - 1).bit_length())):
        halves = (nodes.withColumn("mid", F.expr("(lo + hi) div 2"))
                  .withColumn("goes", F.expr("if(hi - lo > 1, cast(floor(1D * total * (mid - lo) / (hi - lo)) as bigint), total)"))
                  .withColumn("part", F.expr(f"if(hi - lo > 1, {_split(seed)}, entries)")))
        left = "named_struct('lo', lo, 'hi', if(hi - lo > 1, mid, hi), 'total', goes, 'entries', filter(part, e -> e.q > 0))"
        rest = "zip_with(entries, part, (e, l) -> named_struct('sid', e.sid, 'first', e.first + l.q, 'q', e.q - l.q))"
        right = f"named_struct('lo', mid, 'hi', hi, 'total', total - goes, 'entries', filter({rest}, e -> e.q > 0))"
        nodes = halves.selectExpr(f"inline(if(hi - lo > 1, array({left}, {right}), array({left})))")
        if level % 6 == 5:  # a wide level: its nodes go on in parallel
            nodes = write_table(nodes.repartition("lo"))
    return nodes.select(F.col("lo").alias("shard"), F.inline("entries"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, n_docs, source_size, sid, target) from (source, n_docs, source_size)."""
    # numbered in order: a sorted table keeps each row's place within its partition
    ordered = write_table(sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before = (ordered.groupBy(part.alias("part")).agg(F.count("*").alias("k"))
              .withColumn("skip", F.sum("k").over(Window.orderBy("part")) - F.col("k")))
    numbered = ordered.withColumn("part", part).join(before, "part").withColumn(
        "sid", F.col("skip") + F.col("at") - F.shiftleft(F.col("part"), 33))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double")
    table = write_table(numbered.select("source", "n_docs", "source_size", "sid", weight.alias("weight")))
    cap = repeats * F.col("source_size")
    total, level = float(table.agg(F.sum("source_size")).first()[0] or 0), -1.0
    share = F.lit(0.0)
    while True:  # the level only rises, and each time at least one more source is full
        full = cap < share * F.col("weight")
        used, free = table.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        now = (total - (used or 0)) / free if free else float("inf")
        if now <= level:
            break
        level, share = now, F.lit(now)
    return table.select("source", "n_docs", "source_size", "sid",
                        F.least(cap.cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def draw_mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
             weights=WEIGHTS, repeats: int = REPEATS, seed: int = SEED,
             block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """Every document's draws: ``docs`` with ``size``, ``source_size``, ``target`` and for
    each draw ``shard``, ``words`` (how many of its words lie in blocks drawn) and ``spot``
    (the order within the shard); ``row`` names the input row. Documents that are never
    drawn have one row with null shard and 0 words."""
    h = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(source), F.col(text))
    cell = F.pmod(F.xxhash64(F.lit(seed + 1), h), F.lit(1 << CELL_BITS))
    cells = write_table(docs.select(F.col(source).alias("source"), cell.alias("cell"), word_count(F.col(text)).alias("w"))
                        .groupBy("source", "cell").agg(F.sum("w").alias("w"), F.count("*").alias("n")))
    targets = write_table(source_targets(cells.groupBy("source").agg(
        F.sum("n").alias("n_docs"), F.sum("w").alias("source_size")), weights, repeats)
        .withColumn("want", F.round("target").cast("long"))
        .withColumn("shift", (CELL_BITS - F.least(F.lit(CELL_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / BUCKET))))).cast("int"))
        .selectExpr("*", f"greatest(1L, least({block_words}L, want div {PARTS}, source_size)) AS bw",
                    f"if(source_size > 0, least({repeats}L, want div source_size), 0L) AS whole")
        # equal blocks of a stream, and whether words are left behind them; blocks and words of the last, partial pass
        .selectExpr("*", "source_size div bw AS blocks", "cast(source_size % bw > 0 as long) AS tail", "(want - whole * source_size) div bw AS part",
                    "(want - whole * source_size) % bw AS cut")
        .withColumn("q", F.expr("whole * (blocks + tail) + part + cast(cut > 0 as long)")))

    words = targets.agg(F.sum("want")).first()[0] or 0
    leaves = splitting_tree(targets.select("sid", "q"), max(1, -(-words // (shard_blocks * block_words))), seed)
    places = write_table(leaves.select("shard", "sid", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("q") - 1)).alias("place")))

    by = Window.partitionBy("sid").orderBy("bucket")
    starts = write_table(cells.join(targets, cells["source"].eqNullSafe(targets["source"]))
                         .groupBy("sid", F.expr("shiftright(cell, shift)").alias("bucket")).agg(F.sum("w").alias("w"))
                         .select("sid", "bucket", (F.sum("w").over(by) - F.col("w")).alias("start")))

    # the input's columns go by numbers meanwhile, so none can clash with a name used here
    kept = [c for c in docs.columns if c not in DRAWS]
    numbered = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)],
                           word_count(F.col(text)).alias("size"), h.alias("h"), F.col(doc_id).alias("id"), F.col(source).alias("own_source"))
    rows = (numbered.join(targets, F.col("own_source").eqNullSafe(F.col("source")))
            .withColumn("bucket", F.expr(f"shiftright(pmod(xxhash64({seed + 1}, h), {1 << CELL_BITS}L), shift)")))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "id")
    rows = rows.withColumns({"before": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
                             "nth": F.row_number().over(inside)}).join(starts, ["sid", "bucket"])
    # pass e over the stream: all blocks of whole passes, the drawn ones of the partial one
    rows = rows.withColumn("at", F.col("start") + F.col("before"))
    drawn = f"pmod(b * {STEP}L + pmod(xxhash64({seed + 2}L, sid, e), greatest(blocks, 1L)), greatest(blocks, 1L))"
    limit = "if(b = blocks, if(part = blocks, cut, 0L), if(nth < part, bw, if(nth = part, cut, 0L)))"
    held = f"transform(array({drawn}), nth -> named_struct('nth', if(b = blocks, part, nth), 'upto', least(at + size, b * bw + {limit})))[0]"
    partial = f"""aggregate(sequence(at div bw, (at + size - 1) div bw), named_struct('words', 0L, 'place', cast(null as long)),
        (s, b) -> transform(array({held}), h -> transform(array(greatest(0L, h.upto - greatest(at, b * bw))), got -> named_struct(
            'words', s.words + got, 'place', coalesce(s.place, if(got > 0, whole * (blocks + tail) + h.nth, null))))[0])[0])"""
    draws = f"""filter(transform(sequence(0, {repeats}), e -> transform(array(if(size = 0 OR e > whole, named_struct('words', 0L, 'place', cast(null as long)),
        if(e < whole, named_struct('words', size, 'place', e * (blocks + tail) + at div bw), {partial}))), d -> named_struct(
            'e', e, 'words', d.words, 'place', d.place))[0]), d -> d.words > 0)"""
    rows = (rows.withColumn("draw", F.explode_outer(F.expr(draws)))
            .withColumn("place", F.expr(f"if(q > 0, (draw.place * {STEP}L + pmod(xxhash64({seed + 3}L, sid), q)) % q, null)"))
            .join(places, ["sid", "place"], "left"))
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], "size", "source_size", "target", "shard",
                       F.coalesce("draw.words", F.lit(0)).alias("words"),
                       F.xxhash64(F.lit(seed + 3), "h", "draw.e", "nth").alias("spot"), F.struct("sid", "bucket", "nth").alias("row"))


def mixed_documents(draws: DataFrame) -> DataFrame:
    """The mix itself, in whole documents: one row for each draw that takes half of its document's words or
    more, dealt out by shard (a shard in ``SLICES`` random slices, so that few large shards make no
    few large tasks) and shuffled within; ``words`` is the document's size."""
    return (draws.filter((F.col("words") > 0) & (2 * F.col("words") >= F.col("size"))).withColumn("words", F.col("size"))
            .repartition("shard", F.pmod("spot", F.lit(SLICES))).sortWithinPartitions("shard", "spot"))
