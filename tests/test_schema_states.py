"""Class schemas rendered once a class against the expansion of all paths."""
import json

import numpy as np

from apiatlas.operators import jsonmodel as j

FIELDS = ("project string, class string, field string, type string, type_args array<string>, is_enum boolean, is_transient boolean, "
          "annotations array<struct<name:string,key:string,value:string>>")


def fields(spark, rows):
    return spark.createDataFrame([("p", c, f, t, args, False, False, []) for c, f, t, args in rows], FIELDS)


def test_random_class_graphs_like_all_paths(spark):
    rnd = np.random.default_rng(11)
    rows = []
    for g in range(4):
        names = [f"G{g}C{i}" for i in range(6)]
        for c in names[:-1]:  # the last one has no fields
            for f in range(int(rnd.integers(1, 4))):
                ref = str(rnd.choice(names))
                kind = rnd.integers(0, 5)
                rows.append((c, f"f{f}", *[("String", []), (ref, []), ("List", [ref]), ("Map", ["String", ref]), ("List", ["int"])][kind]))
    df = fields(spark, rows)
    roots = df.select("project", "class").distinct()
    got = {r["class"]: r["skeleton"] for r in j.schema_from_fields(df, roots).collect()}
    want = {r["class"]: r["skeleton"] for r in j.schema_from_fields(df, roots, max_depth=60).collect()}
    assert got == want and len(got) > 15


def test_diamond_chain_of_thirty(spark):
    """Ten diamonds: a thousand paths, thirty classes, each rendered once."""
    rows = []
    for k in range(10):
        rows += [(f"A{k}", "l", f"L{k}", []), (f"A{k}", "r", f"R{k}", []), (f"L{k}", "n", f"A{k + 1}", []), (f"R{k}", "n", f"A{k + 1}", [])]
    rows.append(("A10", "end", "int", []))
    roots = spark.createDataFrame([("p", "A0"), ("p", "Missing")], "project string, class string")
    got = {r["class"]: r["skeleton"] for r in j.schema_from_fields(fields(spark, rows), roots).collect()}
    assert got["A0"].count("<NUMBER_INT>") == 1024 and got["Missing"] == "{}"
    at, deep = json.loads(got["A0"]), 0
    while "end" not in at:
        at, deep = at["l"]["n"], deep + 1
    assert deep == 10
