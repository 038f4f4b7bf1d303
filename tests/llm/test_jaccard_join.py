"""Near-duplicate components against all pairs, and the component job."""
import random

from apiatlas.llm import jaccard_join
from apiatlas.llm.components import connected_components


def brute(docs):
    """doc_id -> (set size of each row, smallest doc_id reachable)."""
    sets = []
    for doc, text in docs:
        words = (text or "").encode().lower().split()
        sets.append((doc, {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()))
    name = {d: d for d, _ in docs if d is not None}
    changed = True
    while changed:
        changed = False
        for a, x in sets:
            for b, y in sets:
                if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                    low = min(name[a], name[b])
                    changed |= name[a] != low or name[b] != low
                    name[a] = name[b] = low
    return sorted((str(d), len(s), str(name.get(d))) for d, s in sets)


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join.near_duplicates(df).collect())
    assert got == brute(docs)


def variants(rnd, n, length, edits):
    base = [f"w{rnd.randint(0, 300)}" for _ in range(length)]
    out = [" ".join(base)]
    for _ in range(n):
        words = [*base]
        for _ in range(rnd.randint(0, edits)):
            words[rnd.randrange(length)] = f"e{rnd.randint(0, 10 ** 6)}"
        out.append(" ".join(words))
    return out


def test_groups_of_near_copies(spark):
    rnd = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = variants(rnd, 25, 120, 8) + variants(rnd, 10, 40, 2) + [v + " " + passage for v in variants(rnd, 6, 20, 3)]
    texts += [" ".join(f"u{rnd.randint(0, 99)}" for _ in range(25)) + " " + passage for _ in range(25)]
    texts += [texts[3]] * 12 + [passage] * 3
    rnd.shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_threshold_ties_and_sizes(spark):
    # shingle sets of 4 and 3 with 3 in common: exactly 0.75
    check(spark, [(1, "a b c d e f g h"), (2, "a b c d e f g"), (3, "a b c d e f"), (4, "A B C D E F G H"), (5, "a\tb\nc d\x0be f g h")])


def test_cases(spark):
    long = " ".join(f"x{i}" for i in range(20000))
    check(spark, [(7, None), (8, ""), (9, " \n"), (10, "one"), (11, "ONE"), (12, "one two three four"), (13, long), (14, long + " tail"),
                  (15, "é É"), (16, "é é"), (20, "same text of five words"), (20, "same text of five words"), (21, "same text of five words"),
                  (None, "same text of five words"), (22, "first text that is here now"), (22, "one")])


def test_chains_of_versions(spark):
    # 76 shingles a version, two words changed each time: neighbours share 66, similarity 0.767
    rnd = random.Random(5)
    docs = []
    for c in range(20):
        words = [f"c{c}w{i}" for i in range(80)]
        for v in range(10):
            docs.append(" ".join(words))
            for k in (rnd.randint(5, 35), rnd.randint(42, 74)):
                words[k] = f"c{c}v{v}k{k}"
    rnd.shuffle(docs)
    check(spark, list(enumerate(docs)))


def test_salted_lists(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LIST_SPLIT", 4)
    rnd = random.Random(4)
    check(spark, list(enumerate(variants(rnd, 40, 60, 4))))


def test_keep_one_each(spark):
    df = spark.createDataFrame([(5, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 2), (None, "a b c d e f", 3), (9, None, 4)],
                               "doc_id long, text string, __key int")
    got = jaccard_join.keep_one_each(df)
    assert got.columns == df.columns
    assert sorted((str(r["doc_id"]), r["__key"]) for r in got.collect()) == [("3", 2), ("9", 4), ("None", 3)]
    assert jaccard_join.keep_one_each(df.limit(0)).count() == 0
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(30)] + [(500, i) for i in range(501, 540)] + [(7, 7)]
    name = {v: v for e in edges for v in e}
    for _ in name:
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    df = spark.createDataFrame([*edges, (None, 3)], "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {v: c for v, c in name.items() if v != c}


def test_pairs_of_near_copies_meet_once(spark):
    # 12 documents of 14 common tokens each, no two of one component: 66 pairs, which met 14 times each
    rows = [(lst, doc, 1, lst, 40, True, doc) for doc in range(12) for lst in range(14)]
    schema = "list long, doc long, weight long, pos int, n long, alone boolean, comp long"
    members = spark.createDataFrame(rows, schema)
    met = jaccard_join._met(jaccard_join._open_lists(members))
    assert met.count() == 66 and met.distinct().count() == 66
    assert jaccard_join._cross_pairs(members).count() == 66


def test_ids_of_several_near_copies(spark):
    rnd = random.Random(8)
    texts = variants(rnd, 30, 100, 12)
    check(spark, [(k % 24, t) for k, t in enumerate(texts)] + [(40 + k, texts[k]) for k in range(0, 30, 4)])
