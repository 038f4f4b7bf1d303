"""Jaro-Winkler similarity: the one vectorised (Arrow-batched) Python UDF.

Spark has no built-in for it. The textbook form is used: matching window
max(len)/2 - 1, prefix of at most 4 characters, weight 0.1, prefix boost only
when the Jaro score exceeds 0.7.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ship this module's code with the UDF, so Python workers need no apiatlas install
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PREFIX_WEIGHT = 0.1
MAX_PREFIX = 4
BOOST_THRESHOLD = 0.7


def jaro_winkler(a: str, b: str) -> float:
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    la, lb = len(a), len(b)
    if la == 0 or lb == 0:
        return 0.0
    window = max(0, max(la, lb) // 2 - 1)
    ma, mb = [False] * la, [False] * lb
    m = 0
    for i, ch in enumerate(a):
        lo, hi = max(0, i - window), min(lb, i + window + 1)
        for j in range(lo, hi):
            if not mb[j] and b[j] == ch:
                ma[i] = mb[j] = True
                m += 1
                break
    if m == 0:
        return 0.0
    k = t = 0
    for i in range(la):
        if ma[i]:
            while not mb[k]:
                k += 1
            if a[i] != b[k]:
                t += 1
            k += 1
    jaro = (m / la + m / lb + (m - t / 2) / m) / 3.0
    if jaro <= BOOST_THRESHOLD:
        return jaro
    prefix = 0
    for x, y in zip(a[:MAX_PREFIX], b[:MAX_PREFIX]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * PREFIX_WEIGHT * (1.0 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")
