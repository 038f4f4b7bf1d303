"""Toxic passages: segments against all stretches, held-out accuracy, cases."""
import random

import numpy as np
from pyspark.sql import functions as F

from apiatlas.llm import toxicity


def best_stretch(scores):
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    return max((sums[j] - sums[i] for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=0.0)


def all_maximal(scores, shift=0):
    """Maximal scoring segments by their recursive definition: the best stretch, then both sides of it."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    best = max(((sums[j] - sums[i], -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 1e-12:
        return []
    i = -best[2]
    j = i - best[1]
    return all_maximal(scores[:i], shift) + [(shift + i, shift + j, round(best[0], 9))] + all_maximal(scores[j:], shift + j)


def test_segments_equal_the_definition():
    rnd = random.Random(1)
    for _ in range(400):
        scores = np.array([round(rnd.uniform(-2, 1.6), 3) for _ in range(rnd.randint(0, 25))])
        got = [(a, b, round(s, 9)) for a, b, s in toxicity.maximal_segments(scores)]
        assert got == all_maximal(scores)
        assert max((s for *_, s in got), default=0.0) == max(0.0, round(best_stretch(scores), 9) if len(scores) else 0.0)


def corpus():
    rnd = random.Random(8)
    plain = [f"word{i}" for i in range(400)]
    bad = ["vileword", "nastier", "grubest"]
    rows = []
    for i in range(400):
        words = [rnd.choice(plain) for _ in range(rnd.randint(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            at = rnd.randrange(len(words))
            words[at:at] = [rnd.choice(bad) + rnd.choice(["", "", "ish"]) for _ in range(4)]
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_and_passages(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    out = toxicity.toxicity_scores(docs, labels, F.col("doc_id") % 3 != 0).collect()
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in out if r["doc_id"] % 3 == 0]
    assert np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)
    for r in held:
        if truth[r["doc_id"]] and r["passages"]:
            found = " ".join(r["text"][p["start"]:p["end"]] for p in r["passages"])
            assert any(w in found for w in ("vile", "nast", "grub"))


def test_cases(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] + (1,) for r in rows] + [(None, None, 1), (900, "", 1), (901, "vileword " * 20000, 1), (901, "!?", 1)],
                                 "doc_id long, text string, __toxic int")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (901, None), (0, 1), (0, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity_scores(docs, labels)
    assert out.columns == ["doc_id", "text", "__toxic", "score", "passages"]
    got = out.collect()
    assert len(got) == len(rows) + 4 and all(r["score"] is not None for r in got)
    none = {round(r["score"], 9) for r in got if not r["text"] or r["text"] == "!?"}
    assert len(none) == 1 and none.pop() < 0.5
    assert [r["score"] > 0.5 for r in got if r["text"] and len(r["text"]) > 10 ** 5] == [True]
    assert toxicity.toxicity_scores(docs.limit(0), labels).count() == 0
    for some, rate in ((labels.limit(0), 0.0), (labels.filter("toxic = 1"), 1.0)):
        assert {r["score"] for r in toxicity.toxicity_scores(docs, some).collect()} == {rate}
