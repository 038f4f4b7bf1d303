"""FTRL classifier: one step against the formulas, held-out accuracy, cases."""
import random

import numpy as np
from pyspark.sql import functions as F

from apiatlas.llm import quality_ftrl as q


def corpus():
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(10, 60))]
        good = i % 4 != 0
        if not good:
            words = [w + "###" for w in words] if i % 8 else [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_one_step():
    z, n = np.zeros(9), np.zeros(9)
    q.learn(z, n, np.array([1, 1, 2]), 1)
    x = {1: 2 / np.sqrt(3), 2: 1 / np.sqrt(3), 8: 1.0}
    for at in range(9):
        g = -0.5 * x.get(at, 0.0)
        assert np.isclose(z[at], g) and np.isclose(n[at], g * g)
    w = q.weights_of(z, n)
    for at, v in x.items():
        g = -0.5 * v
        assert np.isclose(w[at], 0.0 if abs(g) <= q.L1 else -(g - np.sign(g) * q.L1) / ((q.BETA + abs(g)) / q.ALPHA + q.L2))


def test_held_out_accuracy_and_reruns(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    def run():
        return {r["doc_id"]: r["score"] for r in q.quality_scores(docs, labels, F.col("doc_id") % 3 != 1).collect()}
    got = run()
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows if i % 3 == 1]) > 0.95
    again = run()
    assert all(abs(got[i] - again[i]) < 1e-9 for i in got)


def test_cases(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] + (0.5,) for r in rows] + [(None, None, 0.5), (900, "", 0.5), (901, "a### " * 50000, 0.5)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (900, None), (0, 0)], "doc_id long, quality int")
    out = q.quality_scores(docs, labels)
    assert out.columns == ["doc_id", "text", "score"]
    got = out.collect()
    assert len(got) == len(rows) + 3 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if not r["text"]}) == 1
    assert [r["score"] < 0.5 for r in got if r["text"] and len(r["text"]) > 10 ** 5] == [True]
    assert q.quality_scores(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in q.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
