"""Work that grows with the input only: no broadcasts of written tables, no walks from what nobody follows."""

import contextlib
import io
import random

from apiatlas.operators import program, resolve

from conftest import rows

EDGES = "project string, caller_var string, callee_var string"
PASSES = "project string, var string, pos int, callee_var string"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_tables_of_source_facts_are_never_broadcast_by_their_file_size(spark):
    corpus = spark.createDataFrame([("p", "A.java", 'class A {\n  String f(String a) { return a + "x"; }\n  void g() { f("y"); }\n}\n')],
                                   "project string, path string, content string")
    facts = program.Program(corpus)
    for df in (program.typed_calls(facts, corpus, []), facts.passes(), facts.links().join(facts.exprs, "project"), facts.values()):
        assert "BroadcastExchange" not in plan(df)


def test_aliases_of_a_tree_need_no_walk_over_all_pairs(spark, monkeypatch):
    edges = [("p", "c", f"o{i}") for i in range(3)] + [("p", f"o{i}", f"l{i}{j}") for i in range(3) for j in range(2)]
    monkeypatch.setattr(resolve, "reach", None)
    got = rows(resolve.alias_through_params(spark.createDataFrame(edges + edges[:2], EDGES)), "var", "root", "depth")
    assert got == sorted([("c", "c", 0)] + [(f"o{i}", "c", 1) for i in range(3)] + [(f"l{i}{j}", "c", 2) for i in range(3) for j in range(2)])


def test_aliases_on_graphs_with_cycles_and_nulls(spark):
    rnd = random.Random(5)
    name = lambda: f"v{rnd.randrange(30):02d}"
    edges = [("p", name(), name()) for _ in range(34)] + [("p", "x", "y"), ("p", "y", "x"), ("p", None, "z"), ("p", "z", "zz"), ("p", "q", None), (None, "n1", "n2")]
    up = {}
    for p, caller, callee in edges:
        up.setdefault((p, callee), set()).add(caller)
    expected = set()
    for start in {v for p, a, b in edges if p for v in (a, b) if v}:
        depth, todo = {start: 0}, [start]
        for v in todo:
            for w in up.get(("p", v), ()):
                if w is not None and w not in depth:
                    depth[w] = depth[v] + 1
                    todo.append(w)
        ends = [v for v in depth if ("p", v) not in up] or [min(depth)]
        expected |= {("p", start, v, depth[v]) for v in ends}
    got = resolve.alias_through_params(spark.createDataFrame(edges, EDGES)).select("project", "var", "root", "depth").collect()
    # what has no name or no project comes as a root and as a loop
    odd = [(None, "n1", "n1", 0), (None, "n2", "n2", 0), ("p", None, None, 0)] * 2
    assert sorted(map(tuple, got), key=repr) == sorted([*expected, *odd], key=repr)


def test_events_meet_steps_before_paths(spark, monkeypatch):
    """Chains, diamonds, two steps into one variable at one position, cycles with and without a root, nulls."""
    monkeypatch.setattr(resolve, "call_paths", None)
    passes = [("p", "r", 1, "a"), ("p", "r", 2, "b"), ("p", "a", 3, "c"), ("p", "b", 3, "c"), ("p", "c", 4, "d"), ("p", "c", 4, "d"), ("p", "r", 5, "e"),
              ("p", "r", 5, "f"), ("p", "e", 6, "g"), ("p", "f", 6, "g"), ("p", "d", 7, "a"), ("p", "x", 1, "y"), ("p", "y", 1, "x"), ("p", "x", 2, "w"),
              ("p", "s", 1, "s"), ("p", None, 1, "c"), ("p", "r", 9, None), (None, "r", 1, "a")]
    events = [(p, v, i, f"t{i}") for p in ("p", None) for i, v in enumerate(["r", "a", "b", "c", "d", "e", "f", "g", "x", "y", "w", "s", "free", None, "g"])]
    events.append(events[7])
    steps = {t for t in passes if t[0] and t[1] and t[3] and t[1] != t[3]}
    called = {t[3] for t in steps}
    paths = {}

    def walk(root, var, met, place):
        for _, first, pos, last in steps:
            if first == var and last not in met:
                paths.setdefault(last, set()).add((root, place + (pos,)))
                walk(root, last, met | {last}, place + (pos,))

    for root in {t[1] for t in steps} - called:
        walk(root, root, {root}, ())
    expected = []
    for p, v, pos, text in events:
        there = paths.get(v) if p else None
        expected += [(p, r, place + (pos,), text) for r, place in there] if there else [(p, v, (pos,), text)]
    got = resolve.events_of_roots(spark.createDataFrame(events, "project string, var string, pos int, text string"), spark.createDataFrame(passes, PASSES))
    assert sorted(((r["project"], r["var"], tuple(r["pos"]), r["text"]) for r in got.collect()), key=repr) == sorted(expected, key=repr)
