"""Mixing: targets, quotas, draws, reruns."""
import pytest
from pyspark.sql import functions as F

from apiatlas.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def corpus(n=300):
    rows = [(i, " ".join(["w"] * (1 + i % 37)), f"s{i % 5}" if i % 3 else "s0") for i in range(n)]
    return rows + [(n, None, "s1"), (n + 1, "", "s2"), (n + 2, "a b c", None), (n + 3, "x " * 5000, "s4"), (n + 4, None, "empty"), (1, "w w", "s1"), (1, "w w", "s1"),
                   (None, "w w w", "s3")]


def targets(sizes):
    """Plain water filling: (source -> target), sources in code-point order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        free = sum(weight[s] for s in order if s not in full)
        level = (total - sum(3 * sizes[s] for s in full)) / free if free else 0
        new = {s for s in order if s not in full and 3 * sizes[s] < level * weight[s]}
        if not new:
            return {s: 3 * sizes[s] if s in full else level * weight[s] for s in order}
        full |= new


def draws_of(spark, rows, **more):
    return mixing.draw_mix(spark.createDataFrame(rows, SCHEMA), block_words=50, shard_blocks=8, **more)


def test_targets_and_taken_words(spark):
    rows = corpus()
    got = draws_of(spark, rows).collect()
    sizes, taken, one = {}, {}, {}
    for r in got:
        one.setdefault(r["row"], [r["size"], 0, r["source"], r["source_size"], r["target"]])[1] += r["words"]
    assert len(one) == len(rows)
    for size, words, source, *_ in one.values():
        sizes[source] = sizes.get(source, 0) + size
        taken[source] = taken.get(source, 0) + words
        assert words <= 3 * size
    want = targets(sizes)
    assert sum(sizes.values()) == sum(len((t or "").split()) for _, t, _ in rows)
    for *_, source, size, target in one.values():
        assert size == sizes[source] and target == pytest.approx(want[source])
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)


def test_every_draw_has_one_shard_and_reruns_agree(spark):
    rows = corpus()
    def digest():
        d = draws_of(spark, rows)
        assert d.filter("words > 0 AND shard IS NULL").count() == 0
        return sorted(map(str, d.select("doc_id", "shard", "words", "spot").collect()))
    first = digest()
    assert first == digest()
    assert len({r["shard"] for r in draws_of(spark, rows).filter("words > 0").collect()}) > 5


def test_tree_keeps_quotas_and_ranges(spark):
    quotas = [(0, 1000), (1, 17), (2, 0), (3, 1), (4, 333)]
    leaves = mixing.splitting_tree(spark.createDataFrame(quotas, "sid long, q long"), 11).collect()
    per_shard, taken = {}, {}
    for r in leaves:
        per_shard[r["shard"]] = per_shard.get(r["shard"], 0) + r["q"]
        taken.setdefault(r["sid"], []).extend(range(r["first"], r["first"] + r["q"]))
    for sid, q in quotas:
        assert sorted(taken.get(sid, [])) == list(range(q))  # disjoint, none missing
    assert set(per_shard) == set(range(11)) and max(per_shard.values()) - min(per_shard.values()) <= 4


def test_hypergeometric_draws(spark):
    sql = mixing._hypergeometric("total", "good", "drawn", "u")
    for N, K, n in ((50, 20, 10), (7, 7, 3), (1000, 300, 500), (10, 0, 4), (5, 2, 5)):
        df = spark.range(4000).selectExpr(f"{N}L AS total", f"{K}L AS good", f"{n}L AS drawn", "(id + 0.5D) / 4000 AS u").selectExpr(f"{sql} AS x")
        low, high, mean, var = df.agg(F.min("x"), F.max("x"), F.avg("x"), F.var_pop("x")).first()
        assert low >= max(0, n + K - N) and high <= min(n, K)
        assert mean == pytest.approx(n * K / N, abs=0.02)
        assert var == pytest.approx(n * K / N * (N - K) / N * (N - n) / max(1, N - 1), rel=0.05, abs=0.01)


def test_mixed_documents_hold_the_words(spark):
    rows = corpus(60)
    d = draws_of(spark, rows)
    mixed = mixing.mixed_documents(d).collect()
    whole = {t for _, t, _ in rows}  # no document is cut
    assert all(r["text"] in whole and len(r["text"].split()) == r["words"] == r["size"] for r in mixed)
    drawn = sorted((r["row"], r["spot"]) for r in d.collect() if r["words"] and 2 * r["words"] >= r["size"])
    assert sorted((r["row"], r["spot"]) for r in mixed) == drawn


def plain_draws(rows, got, block_words, seed=mixing.SEED):
    """Words of each row by walking every source's stream block by block. The stream's order and the blocks'
    permutation come from Spark (``got`` holds each row's place and its source's numbers)."""
    out = {}
    for key, (at, size, source_size, want, shift) in got.items():
        bw = max(1, min(block_words, want // mixing.PARTS, source_size))
        whole, rest = divmod(want, source_size) if source_size else (0, 0)
        whole = min(mixing.REPEATS, whole)
        blocks, part, cut = source_size // bw, (want - whole * source_size) // bw, (want - whole * source_size) % bw
        taken = whole * size
        for w in range(at, at + size):
            b = w // bw
            nth = (b * mixing.STEP + shift % max(blocks, 1)) % max(blocks, 1) if b < blocks else part if part == blocks else part + 1
            if b < blocks:
                taken += nth < part or nth == part and w % bw < cut
            else:
                taken += part == blocks and w - blocks * bw < cut
        out[key] = taken
    return out


@pytest.mark.parametrize("block_words", [7, 50])
def test_blocks_drawn_decide_what_is_taken(spark, block_words):
    rows = corpus(200)
    d = mixing.draw_mix(spark.createDataFrame(rows, SCHEMA), block_words=block_words, shard_blocks=8)
    one, places = {}, {}
    for r in d.collect():
        key = tuple(r["row"])
        one.setdefault(key, [r["size"], 0, r["source_size"], round(r["target"])])[1] += r["words"]
    for sid, bucket, nth in sorted(one):  # the stream: buckets, and rows within them, in order
        places.setdefault(sid, []).append((sid, bucket, nth))
    shifts = {}
    for sid in places:
        size, want = one[places[sid][0]][2:]
        e = min(mixing.REPEATS, want // size) if size else 0
        shifts[sid] = spark.sql(f"SELECT xxhash64({mixing.SEED + 2}L, CAST({sid} AS BIGINT), {e}) AS h").first()["h"]
    got = {}
    for sid, keys in places.items():
        at = 0
        for key in keys:
            size, _, source_size, want = one[key]
            got[key] = (at, size, source_size, want, shifts[sid])
            at += size
    assert {k: v[1] for k, v in one.items()} == plain_draws(rows, got, block_words)
    other = mixing.draw_mix(spark.createDataFrame(rows, SCHEMA), block_words=3, shard_blocks=8)
    words = lambda df: sorted((tuple(r["row"]), r["words"]) for r in df.collect())
    assert words(other) != words(d)


def test_clashes_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", "s", 3, 4, "x")], SCHEMA + ", size int, q int, place string")
    out = mixing.draw_mix(df)
    assert out.columns == ["doc_id", "text", "source", "q", "place", *mixing.DRAWS]
    assert out.first()["q"] == 4
    assert mixing.draw_mix(df.limit(0)).count() == 0
    assert [r["words"] for r in mixing.draw_mix(df.withColumn("text", F.lit(None).cast("string"))).collect()] == [0]
