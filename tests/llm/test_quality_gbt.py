"""Statistics against plain counting; trees: order, flattening, accuracy, cases."""
import random
import re
from collections import Counter

import numpy as np

from apiatlas.llm import quality_gbt as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if runs[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def texts():
    rnd = random.Random(7)
    out = [None, "", " \n\t ", "one", "é漢🎉 x y\x1cz", "a b c d e f g h " * 3, "l\nl\nl \n\nl", "#$%&|<>*" * 5, "w " * 20000]
    for _ in range(120):
        out.append("".join(rnd.choice(["a", "b", "ab", " ", " ", "\n", "#", "é"]) for _ in range(rnd.randint(0, 120))))
    return out


def test_counts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    for r in q.judge(df, none).collect():
        want = plain(texts()[r["doc_id"]])
        assert tuple(r[c] for c in q.COUNTS) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r["kept"] == (not r["base_failed"])  # no labels: the trees keep all


def data(n=3000):
    rnd = np.random.default_rng(4)
    x = rnd.random((n, len(q.FEATURES)))
    bad = (x[:, q.FEATURES.index("symbol_share")] > 0.6) | (x[:, q.FEATURES.index("upper_share")] > 0.8)
    return x, (bad == (rnd.random(n) < 0.02)).astype(float)


def test_flat_trees_step_as_written_out():
    x, y = data(800)
    trees = q.fit_trees(x, y)
    logits = trees.logits(x)
    for row in range(0, 800, 37):
        total = trees.base
        for k in trees.roots:
            while trees.left[k] != k:
                k = trees.left[k] if x[row, trees.feature[k]] <= trees.threshold[k] else trees.right[k]
            total += trees.value[k]
        assert np.isclose(total, logits[row])


def test_accuracy_and_order():
    x, y = data()
    trees = q.fit_trees(x[:2000], y[:2000])
    assert np.mean((trees.logits(x[2000:]) > 0) == y[2000:]) > 0.95
    for name in q.MONOTONE:
        steps = np.repeat(x[2000:2100], 30, axis=0)
        steps[:, q.FEATURES.index(name)] = np.tile(np.linspace(0, 1, 30), 100)
        assert (np.diff(trees.logits(steps).reshape(100, 30), axis=1) <= 1e-9).all()


def test_cases(spark):
    df = spark.createDataFrame([(None, "a " * 30, 1), (1, "a b " * 30, 1), (1, "c d e f", 1)], "doc_id long, text string, y int")
    labels = spark.createDataFrame([(None, 1), (1, None), (1, 1), (1, 0), (2, 0)], "doc_id long, quality int")
    got = q.judge(df, labels)
    assert got.columns == ["doc_id", *q.COUNTS, "base_failed", "quality", "kept"] and got.count() == 3
    assert q.judge(df.limit(0), labels).count() == 0
