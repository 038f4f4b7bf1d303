"""Embedding near-duplicates against all pairs."""
import numpy as np

from apiatlas.llm import pivot_index as p

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    good = []
    for i, (vec, v, label) in enumerate(rows):
        ok = vec is not None and v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        good.append(np.array(v, np.float32).astype(np.float64) if ok else None)
    links = [[j for j in range(len(rows)) if j != i and good[i] is not None and good[j] is not None and rows[i][2] == rows[j][2]
              and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.98] for i in range(len(rows))]
    comp = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            low = min([comp[i], *[comp[j] for j in near]]) if near else comp[i]
            for j in [i, *near] if near else []:
                changed |= comp[j] != low
                comp[j] = low
    return sorted((str(r[0]), len(links[i]), str(comp[i])) for i, r in enumerate(rows))


def check(spark, rows):
    got = [(str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in p.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == brute(rows)


def group(rnd, n, spread, dim=24):
    base = rnd.normal(size=dim)
    return [(base + spread * np.linalg.norm(base) / dim ** 0.5 * rnd.normal(size=dim)).tolist() for _ in range(n)]


def test_groups(spark):
    rnd = np.random.default_rng(5)
    vectors = group(rnd, 40, 0.05) + group(rnd, 60, 0.13) + [rnd.normal(size=24).tolist() for _ in range(150)]
    vectors += [vectors[0]] * 20
    check(spark, [(i, v, i % 2) for i, v in enumerate(vectors)])


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(p, "BLOCK", 8)
    rnd = np.random.default_rng(6)
    check(spark, [(i, v, 1) for i, v in enumerate(group(rnd, 90, 0.1))])


def test_cases(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 3.0], 1), (5, [float("nan"), 1.0, 1.0], 1), (6, [float("inf"), 1.0, 1.0], 1),
            (7, one, None), (8, one, 1), (9, one, 1), (9, one, 1), (10, one, 2), (11, [2.0, 4.0, 6.0], 1), (12, [1.0, 2.0], 1), (13, [1e30, 2e30, 3e30], 1),
            (14, [-1.0, -2.0, -3.0], 1), (None, one, 1), (15, one + [0.0], 1)]
    check(spark, rows)


def test_kept_extra_columns_and_empty(spark):
    df = spark.createDataFrame([(5, [1.0, 0.0], 1, "x"), (3, [1.0, 0.0], 1, "y"), (8, None, 1, "z")], SCHEMA + ", id string")
    got = sorted((r["vec_id"], r["component_id"], r["kept"]) for r in p.near_duplicates(df).collect())
    assert got == [(3, 3, True), (5, 3, False), (8, 8, True)]
    assert p.near_duplicates(df.limit(0)).count() == 0


def planted(rnd, n, dim, mean):
    """n vectors of a given mean cosine, and for each a partner at cosine 0.981 to 1."""
    top = np.zeros(dim)
    top[0] = 1
    spread = rnd.normal(size=(n, dim))
    x = p.unit(np.sqrt(mean) * top + np.sqrt(1 - mean) * spread / np.linalg.norm(spread, axis=1, keepdims=True))
    turn = rnd.normal(size=x.shape)
    turn -= (turn * x).sum(axis=1, keepdims=True) * x
    cosine = rnd.uniform(0.981, 1, (n, 1))
    return x, cosine * x + np.sqrt(1 - cosine ** 2) * p.unit(turn)


def test_recall_of_the_index_and_short_lists():
    """Also where all vectors are alike: pivots spread after the mean is taken off."""
    rnd = np.random.default_rng(12)
    for dim, mean in ((8, 0.0), (64, 0.0), (64, 0.5), (128, 0.8), (768, 0.8), (64, 0.95)):
        x, y = planted(rnd, 3000, dim, mean)
        index = p.Index(x[:2000])
        a, b = index.nearest(x), index.nearest(y)
        common = (a[:, :, None] == b[:, None, :]).any(axis=2).sum(axis=1)
        assert (common >= index.shared).mean() >= 0.94, (dim, mean, index.shared)
        if dim > 8 and mean < 0.9:
            assert len(index.pivots) == p.PIVOTS and index.shared > 1
            cells = [c for some in p.combinations(range(p.NEAREST), index.shared) for c in p.cell_of(np.sort(a, axis=1)[:, list(some)], dim).tolist()]
            assert np.unique(cells, return_counts=True)[1].max() <= 60


def test_planted_links_are_found(spark):
    rnd = np.random.default_rng(13)
    for mean in (0.0, 0.8):
        x, y = planted(rnd, 400, 64, mean)
        rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(1000 + i, v.tolist(), i % 3) for i, v in enumerate(y)]
        want = brute(rows)
        got = {str(r["vec_id"]): r["n_links"] for r in p.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
        links = sum(n for _, n, _ in want)
        assert links >= 800 and all(got[i] <= n for i, n, _ in want) and sum(got.values()) >= 0.95 * links


def test_many_small_lists_in_slices(spark, monkeypatch):
    monkeypatch.setattr(p, "NUMBERS", 200)
    monkeypatch.setattr(p, "SMALL", 3)
    rnd = np.random.default_rng(3)
    check(spark, [(i, v, 1) for i, v in enumerate(group(rnd, 40, 0.08) + group(rnd, 30, 0.05) + [rnd.normal(size=24).tolist() for _ in range(60)])])
