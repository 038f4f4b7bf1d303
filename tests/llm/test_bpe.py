"""BPE: equal to the library, cuts, cases."""
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from apiatlas.llm import bpe
from apiatlas.llm.queries import VOCABULARY

TEXTS = [None, "", "   \n\t", "Hello world! naïve", "ΣΑΣ ΟΔΟΣ", "İstanbul", "é ́x", "it's 'S I'LL 123", "a\x1cb c d\te", "</w> a</w>",
         "<|startoftext|>A<|endoftext|>b", "<|endOftext|> <|", "ﬁ Ǆ ẞ", "x" * 3000, "ab" * 2000, "日本語テキスト", "👩‍👩‍👧🎉", "½ ² Ⅷ 𝟘",
         "\ufeffhi\u200bthere", "K Å Ω", "word " * 500]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_padding()
    t.no_truncation()
    return t


def test_same_as_library(spark, library):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in bpe.encode_decode(df, VOCABULARY).collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"])) == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_random_texts(library):
    codec, rnd = bpe.Codec(bpe.load_spec(VOCABULARY), remember=50), random.Random(3)
    signs = "abcdefghijk ABC áéß'’.,!<>/w0123\n\t漢🎉é"
    for _ in range(300):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60)))
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_cuts_stand_inside_no_token():
    codec = bpe.Codec(bpe.load_spec(VOCABULARY))
    for token in ("hello</w>", "th", "!</w>"):
        parts = bpe.split_symbols(token)
        assert all(b in codec.inside[a] for a, b in zip(parts, parts[1:]))


def test_long_fragments_merge_alike():
    codec = bpe.Codec(bpe.load_spec(VOCABULARY))
    rnd = random.Random(5)
    for _ in range(200):
        parts = [rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 24))]
        long = codec._merge_long([*parts])
        assert b"".join(codec.packed[p] for p in long) == codec._merge("".join(parts))


def test_extra_and_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", 7, "keep")], "doc_id long, text string, __bpe int, other string")
    out = bpe.encode_decode(df, VOCABULARY)
    assert out.columns == ["doc_id", "text", "__bpe", "other", "ids", "decoded"]
    assert out.select(bpe.token_count(F.col("ids"))).first()[0] == 2
    assert bpe.encode_decode(df.limit(0), VOCABULARY).count() == 0


def test_a_task_remembers_two_hundred_thousand_runs():
    made = []

    class Counting(bpe.Codec):
        def _chunk(self, chunk):
            made.append(chunk)
            return b""

    codec = Counting(bpe.load_spec(VOCABULARY))
    for _ in range(2):
        codec.encode(" ".join(map(str, range(200_000))))
    assert len(made) == 200_000
