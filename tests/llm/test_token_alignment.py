"""Alignment of two tokenizers against a plain loop over the libraries' own ids."""
import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from apiatlas.llm import token_alignment as t
from apiatlas.llm.bpe import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, number string, kind int"


def groups_of(text, one, two, bytes_a, bytes_b):
    if not text:
        return []
    raw = (" " + text).encode()
    a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
    if b"".join(bytes_a[i] for i in a) != raw or b"".join(bytes_b[i] for i in b) != raw:
        return []
    ends = lambda ids, table: np.cumsum([len(table[i]) for i in ids]).tolist()
    ea, eb = ends(a, bytes_a), ends(b, bytes_b)
    cuts = set(ea) & set(eb)

    def cut_up(ids, at):
        parts = [[]]
        for i, e in zip(ids, at):
            parts[-1].append(i)
            if e in cuts:
                parts.append([])
        return parts[:-1]

    return list(zip(cut_up(a, ea), cut_up(b, eb)))


def brute(rows):
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    byte_of = {s: i for i, s in enumerate(byte_symbols())}
    bytes_a = {i: bytes(byte_of[c] for c in tok) for tok, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    bytes_b = [bytes([int(p[3:5], 16)]) if p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(two.id_to_piece, range(two.get_piece_size()))]
    groups = [groups_of(r[1], one, two, bytes_a, bytes_b) for r in rows]
    links = [Counter((a, b) for ga, gb in g for a in ga for b in gb) for g in groups]
    count = Counter(p for own in links for p in own)
    top = {}
    for (a, _), n in count.items():
        top[a] = max(top.get(a, 0), n)
    out = []
    for r, g, own in zip(rows, groups, links):
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in g)
        out.append((str(r[0]), sum(len(x) for x, _ in g), sum(len(x) for _, x in g), len(g), sum(own.values()),
                    sum(n for p, n in own.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in own.items()),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out)


def run(spark, rows, parts=3):
    got = t.align(spark.createDataFrame(rows, SCHEMA).repartition(parts) if parts else spark.createDataFrame(rows, SCHEMA), A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in got.collect())


CASES = [(1, "The quick brown fox jumps over the lazy dog.", "x", 1), (2, None, None, None), (3, "", "", 0), (4, "a", "a", 0),
         (5, "naïve café Ω漢字仮名 🙂🙂 ß\tq\n\n  z", "x", 1), (6, "▁under▁score", "", 1), (7, "<|endoftext|> <s> </s> <unk> <0x41>", "", 1),
         (8, "   leading and trailing   ", "", 1), (9, "\x00\x01\x7f", "", 0), (10, "antidisestablishmentarianism " * 40, "", 0),
         (11, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab" * 20, "", 0), (12, "1234567890 3.14159 1e-10 don't we'll I'VE", "", 0),
         (None, "a null id", None, None), (1, "The quick brown fox jumps over the lazy dog.", "y", 2), (13, "ﬁ ① ½ é   　", "", 0)]


def test_like_plain_loop(spark):
    rnd = np.random.default_rng(4)
    pool = "the of and then thereby rain Rainbow un-do 12 123 . , ! ü zß 漢 🙂 \n".split(" ")
    rows = CASES + [(100 + i, " ".join(rnd.choice(pool, int(rnd.integers(0, 40)))), "", 0) for i in range(60)]
    rows += [(200 + i, " ".join(["rain"] * 50 + ["Rainbow"] * (i % 9)), "", 0) for i in range(40)]
    assert run(spark, rows) == brute(rows)


def test_small_chunks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(t, "CHUNK_BYTES", 300)
    monkeypatch.setattr(t, "SLICE_BYTES", 100)
    rows = CASES * 3
    assert run(spark, rows, 2) == brute(rows)


def test_whole_table_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], "", 0) for r in docs.collect()]
    assert sorted((str(r[0]), *r[1:]) for r in t.align(docs, A, B).collect()) == brute(rows)


def test_empty_table_and_long_text(spark):
    assert run(spark, [], 0) == []
    rows = [(1, "word " * 60_000 + "x" * 20_000, "", 0), (2, None, "", 0)]
    assert run(spark, rows, 1) == brute(rows)


def test_bitmaps_come_back():
    rnd = np.random.default_rng(0)
    want = {}
    for pair, many in enumerate([1, 3, 255, 256, 257, 4096, 2000]):
        for number in rnd.choice(t.CHUNK, many, replace=False).tolist():
            want[pair, number] = int(rnd.integers(1, 1 + [1, 2, 3, 9, 1, 1000, 5][pair]))
    keys = np.array(sorted(want))
    maps = t.pack(keys[:, 0], keys[:, 1], np.array([want[tuple(k)] for k in keys.tolist()]) - 1, 7)
    assert [len(m[0].as_py()) for m in maps] == [2, 6, 510, 512, 512, 512, 512]
    for lists, shift in ((maps, 0), (maps.slice(2, 3), 2)):
        row, number, weight = t.unpack(lists)
        got = Counter()
        for r, n, w in zip(row.tolist(), number.tolist(), weight.tolist()):
            got[r + shift, n] += w
        assert got == {k: v for k, v in want.items() if shift <= k[0] < shift + len(lists)}


def test_links_multiply_repeats():
    group, a, b, times = t.links_of(np.array([0, 0, 0, 1]), np.array([5, 5, 6, 7]), np.array([0, 0, 1]), np.array([1, 2, 3]), 2)
    assert sorted(zip(group.tolist(), a.tolist(), b.tolist(), times.tolist())) == [(0, 5, 1, 2), (0, 5, 2, 2), (0, 6, 1, 1), (0, 6, 2, 1), (1, 7, 3, 1)]
