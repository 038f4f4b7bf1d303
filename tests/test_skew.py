"""Hot keys spread over many range partitions must give the same results as a
plain single-group computation (brute force in Python)."""

import random


from apiatlas.operators import facts
from apiatlas.operators.urls import product_fold
from apiatlas.sources.sinks import number_within


def test_number_within_hot_group(spark):
    rnd = random.Random(7)
    data = [("hot", rnd.randint(0, 10_000)) for _ in range(3000)] + [(f"k{i}", i) for i in range(50)]
    df = spark.createDataFrame(data, "g string, o int")
    got = number_within(df, ["g"], ["o"], num_partitions=16).filter("g = 'hot'").select("o", "rn").collect()
    got = sorted((r["rn"], r["o"]) for r in got)
    assert [rn for rn, _ in got] == list(range(1, 3001))
    assert [o for _, o in got] == sorted(o for g, o in data if g == "hot")


def test_maximal_spans_hot_file(spark):
    rnd = random.Random(11)
    spans = []
    for _ in range(2000):
        s = rnd.randint(0, 5000)
        spans.append(("hot", s, s + rnd.randint(0, 300)))
    spans += [("cold", 1, 5), ("cold", 2, 3)]
    df = spark.createDataFrame(spans, "path string, start int, end int")
    got = sorted(tuple(r) for r in facts.keep_maximal_spans(df, num_partitions=16).collect())
    expect, best = [], {}
    for p, s, e in sorted(spans, key=lambda x: (x[0], x[1], -x[2])):
        if p not in best or e > best[p]:
            expect.append((p, s, e))
        best[p] = max(best.get(p, e), e)
    assert got == sorted(expect)


def test_product_fold_hot_builder(spark):
    steps = [("hot", i, [chr(97 + i % 26)]) for i in range(500)] + [("hot", 500, ["X", "Y"])] + \
            [("b", 0, ["p", "q"]), ("b", 1, ["r"]), ("b", 2, ["s", "t"])]
    df = spark.createDataFrame(steps, "k string, pos int, alts array<string>")
    got = {}
    for r in product_fold(df, ["k"], "pos", "alts", num_partitions=16).collect():
        got.setdefault(r["k"], []).append(r["value"])
    body = "".join(chr(97 + i % 26) for i in range(500))
    assert sorted(got["hot"]) == [body + "X", body + "Y"]
    assert sorted(got["b"]) == ["prs", "prt", "qrs", "qrt"]
    capped = [r["value"] for r in product_fold(df.filter("k = 'b'"), ["k"], "pos", "alts", max_alternatives=3,
                                                num_partitions=4).collect()]
    assert sorted(capped) == ["prs", "prt", "qrs"]
