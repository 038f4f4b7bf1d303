"""Threshold walk and clustering against plain loops."""
import hashlib

import numpy as np

from apiatlas.llm import centroid_threshold as c

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, x int"


def brute(rows, k, rounds, dims, seed=3):
    kept = [(i, [int(np.floor(float(np.float32(e)) * 1024)) for e in v]) for i, v, *_ in rows
            if v is not None and len(v) == dims and all(e is not None and np.isfinite(e) for e in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    cents = [v for _, v in sorted(kept, key=key)[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(cents))

    for _ in range(rounds):
        got = [near(v)[1] for _, v in kept]
        cents = [[sum(col) // len(col) for col in zip(*own)] if (own := [v for (_, v), g in zip(kept, got) if g == j]) else m
                 for j, m in enumerate(cents)]
    return sorted((str(i), near(v)[1], near(v)[0]) for i, v in kept), cents


def run(spark, rows, k=4, rounds=5, dims=6):
    out, cents = c.cluster(spark.createDataFrame(rows, SCHEMA), k, rounds, 3, dims)
    return sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in out.collect()), cents, out


def test_walk_finds_the_nearest_with_ties():
    rnd = np.random.default_rng(5)
    for spread in (2, 5, 1000):  # small grids give many ties and equal centroids
        for k in (1, 2, 7, 20):
            cents = rnd.integers(-spread, spread, (k, 5))
            x = rnd.integers(-spread, spread, (300, 5))
            d = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
            number, best = c.Lists(cents.tolist()).nearest(x.astype(np.int64))
            assert (number == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_walk_stops_early():
    """A vector beside one centroid must not pay for a hundred far ones."""
    class Counted(np.ndarray):
        pass
    cents = [[100_000 * i] * 4 for i in range(100)]
    lists = c.Lists(cents)
    seen = []
    real = np.einsum
    np.einsum = lambda *a: (seen.append(len(a[1])), real(*a))[1]
    try:
        number, best = lists.nearest(np.full((1, 4), 3_100_001))
    finally:
        np.einsum = real
    assert number.tolist() == [31] and best.tolist() == [4] and sum(seen) <= 2


def test_clusters_like_plain_loops(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, (rnd.integers(0, 4) + rnd.normal(size=6) * 0.3).tolist(), 1, "c", 7) for i in range(200)]
    rows += rows[:20]  # repeated rows
    rows += [(900, None, 1, None, None), (901, [1.0] * 5, 1, None, 1), (902, [float("nan")] * 6, 1, None, 1), (903, [None] * 6, 1, None, 1),
             (904, [float("inf")] + [0.0] * 5, 1, None, 1), (None, [0.5] * 6, None, None, None), (905, [0.0] * 6, None, None, None), (906, [], 1, None, 1)]
    got, cents, out = run(spark, rows)
    want, means = brute(rows, 4, 5, 6)
    assert got == want and cents == means
    total = c.with_inertia(out, cents).collect()
    assert {r["inertia"] for r in total} == {sum(d for _, _, d in want)}
    for r in total:
        assert r["cluster_inertia"] == sum(d for _, g, d in want if g == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, means[r["cluster"]])).encode()).hexdigest()


def test_all_equal_fewer_than_k_and_empty(spark):
    rows = [(i, [0.25, -0.75, 0.0, 0.0, 0.0, 1.0], 1, "", 0) for i in range(50)]
    got, cents, _ = run(spark, rows)
    assert got == brute(rows, 4, 5, 6)[0] and {g for _, g, _ in got} == {0} and len(cents) == 4
    got, cents, _ = run(spark, rows[:2])
    assert got == brute(rows[:2], 4, 5, 6)[0] and len(cents) == 2
    out, cents = c.cluster(spark.createDataFrame([], SCHEMA), 4, 5, 3, 6)
    assert c.with_inertia(out, cents).collect() == [] and cents == []


def test_negative_means_round_down(spark):
    rows = [(1, [-1 / 1024] * 6, 1, "", 0), (2, [0.0] * 6, 1, "", 0)]
    _, cents, _ = run(spark, rows, k=1, rounds=1)
    assert cents == [[-1] * 6]
