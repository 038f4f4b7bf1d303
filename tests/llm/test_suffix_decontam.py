"""Benchmark windows found by suffix arrays against plain loops."""
import re

import numpy as np
import pyarrow as pa
import pytest

from apiatlas.llm import suffix_decontam as s

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n_words string, items int"
ITEMS = "item_id long, text string"


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    out = []
    for doc in docs:
        own, hit, ids, longest = words(doc[1]), set(), set(), 0
        for item, text in items:
            test = words(text)
            w = min(width, len(test))
            for i in range(len(own)):
                for j in range(len(test) - w + 1 if w else 0):
                    if own[i:i + w] == test[j:j + w]:
                        n = w
                        while i + n < len(own) and j + n < len(test) and own[i + n] == test[j + n]:
                            n += 1
                        hit.update(range(i, i + w))
                        ids |= {str(item)} - {"None"}
                        longest = max(longest, n)
        out.append((str(doc[0]), len(own), len(hit), sorted(ids), longest))
    return sorted(out, key=repr)


def run(spark, docs, items, **options):
    got = s.match_benchmark(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options)
    return sorted(((str(r["doc_id"]), r["n_words"], sum(x["last"] - x["first"] for x in r["runs"]), list(r["items"]), r["longest"])
                   for r in got.collect()), key=repr)


def cases(seed=3, n=60):
    """Few different words, so that windows repeat and overlap in many ways."""
    rnd = np.random.default_rng(seed)
    make = lambda k: " ".join(rnd.choice(["ab", "Cd", "e1", "ü-f", "g"], k))
    items = [(i, make(int(rnd.integers(1, 16)))) for i in range(12)] + [(3, make(14)), (None, make(4)), (90, None), (91, ""), (92, "-- !"), (0, "Ab"),
                                                                     (77, " ".join(f"long{i}" for i in range(40)))]
    docs = [(i, make(int(rnd.integers(0, 60))), "x", 1) for i in range(n)]
    docs += [(200, None, None, None), (201, "", None, 1), (202, "?!", "n", 1), (None, make(30), None, None), docs[5], docs[5],
             (203, "x " * 30 + " ".join(f"Long{i}" for i in range(5, 33)) + " y", "", 0)]
    return docs, items


@pytest.mark.parametrize("width", [10, 3])
def test_like_plain_loops(spark, width):
    docs, items = cases()
    assert run(spark, docs, items, window=width) == brute(docs, items, width)


def test_blocks_of_the_benchmark(spark):
    docs, items = cases(4, 30)
    docs += [(300, " ".join(f"long{i}" for i in range(12)) + " ab", "", 0)]
    assert run(spark, docs, items, block_bytes=150) == brute(docs, items)


def test_long_documents_in_overlapping_shards(monkeypatch):
    rnd = np.random.default_rng(2)
    docs = [(i, " ".join(rnd.choice(["a", "b", "c"], 500))) for i in range(3)]
    items = [(i, " ".join(rnd.choice(["a", "b", "c"], 25))) for i in range(40)] + [(99, " ".join(words(docs[1][1])[30:130]))]
    monkeypatch.setattr(s, "SHARD", 64)
    n, runs, ids, longest = s._judge_batch(pa.array([d[1] for d in docs]), s.Items.of(items, 10))
    got = sorted([(str(d[0]), int(n[i]), sum(r["last"] - r["first"] for r in runs[i]), ids[i], int(longest[i])) for i, d in enumerate(docs)], key=repr)
    assert got == brute(docs, items)


def test_words_across_hash_pieces(monkeypatch):
    text = "the quick brown fox " * 400 + "z" * 5000 + " end"
    whole = s.word_spans(s.FOLD[np.frombuffer(text.encode(), np.uint8)])[2]
    assert len(whole) == 1602 and len(np.unique(whole)) == 6
    monkeypatch.setattr(s, "PIECE", 64)
    cut = s.word_spans(s.FOLD[np.frombuffer(text.encode(), np.uint8)])[2]
    assert (cut[:1600] == whole[:1600]).all() and cut[-1] == whole[-1]


def test_no_items_no_documents_and_removal(spark):
    docs, items = cases(6, 10)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, docs, [(1, None), (2, "...")]) == brute(docs, [])
    assert run(spark, [], items) == []
    kept = s.remove_contaminated(spark.createDataFrame(docs, DOCS).drop("items", "n_words"), spark.createDataFrame(items, ITEMS))
    want = sorted(r[0] for r in brute(docs, items) if not r[2])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == want and kept.columns == ["doc_id", "text"]
