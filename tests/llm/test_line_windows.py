"""Line dedup against a plain loop."""
import random

from apiatlas.llm import line_windows


def brute(docs):
    """Cleaned text by (doc_id, text)."""
    seen, covered = set(), {}
    for doc, text in sorted({(d, t) for d, t, *_ in docs if t is not None}, key=lambda x: (x[0] is None, x[0] or 0)):
        full = [(i, line) for i, line in enumerate(text.split("\n")) if line.strip(" \t\n\r\x0b\x0c")]
        gone = covered.setdefault((doc, text), set())
        for k in range(len(full) - 2):
            window = tuple(line for _, line in full[k:k + 3])
            if window in seen:
                gone.update(i for i, _ in full[k:k + 3])
            seen.add(window)
    return {key: "\n".join(line for i, line in enumerate(key[1].split("\n")) if i not in gone) for key, gone in covered.items()}


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    out = line_windows.drop_repeated_lines(df)
    # cleaned texts, by the number of times each must come
    got = sorted((str(r["doc_id"]), r["text"] or "", r["n_removed"]) for r in out.collect())
    def removed(d, t):
        return len(t.split("\n")) - (len(want[d, t].split("\n")) if want[d, t] or t == "" else 0)
    expected = sorted((str(d), want[d, t] if t is not None else "", removed(d, t) if t is not None else 0) for d, t in docs)
    assert [g[:2] for g in got] == [e[:2] for e in expected]


def test_random_documents(spark):
    rnd = random.Random(9)
    docs = [(i, "\n".join(rnd.choice(["a", "b", "c", "d", "", "  "]) for _ in range(rnd.randint(0, 14)))) for i in range(60)]
    check(spark, docs)


def test_cases(spark):
    long = "\n".join(f"line {i}" for i in range(3000))
    check(spark, [(1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, None), (4, ""), (5, "a\nb"), (6, "a\na\na\na\na"), (7, long), (8, long + "\nmore"),
                  (9, "a\nb\nc\nd"), (9, "a\nb\nc\nd"), (None, "a\nb\nc"), (10, "\n\n\n\n"), (11, " \n\t\n\r\n")])


def test_windows_cover_only_what_repeats(spark):
    df = spark.createDataFrame([(1, "p\nq\nr\ns"), (2, "q\nr\ns\nt"), (3, "q\nr\nt")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_windows.drop_repeated_lines(df).collect()}
    assert got == {1: "p\nq\nr\ns", 2: "t", 3: "q\nr\nt"}


def test_clashes_and_empty(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 1, "k")], "doc_id long, text string, __d1 long, h1 string")
    out = line_windows.drop_repeated_lines(df)
    assert out.columns == ["doc_id", "text", "__d1", "h1", "n_lines", "n_removed"]
    assert out.first()["n_lines"] == 3
    assert line_windows.drop_repeated_lines(df.limit(0)).count() == 0
