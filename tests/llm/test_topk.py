"""Operator 6 against all pairs."""

import math
import random

from pyspark.sql import functions as F

from glosa.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int"


def brute(rows, k):
    """Each row is a candidate, and a query if its id is; rows may share ids."""
    vec = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, q) in enumerate(vec):
        if i % 100 == 0:
            s = sorted((-sum(a * b for a, b in zip(q, p)), j) for to, (j, p) in enumerate(vec) if to != at)[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def rows():
    rng = random.Random(9)
    grid = [k / 64 for k in range(-40, 40)]  # exact as floats; many ties
    out = [(i, [rng.choice(grid) if rng.random() < 0.6 else 0.0 for _ in range(6)]) for i in range(0, 700)]
    out += [(700, None), (800, [1.0, None]), (900, [float("nan")]), (1000, [float("inf")]), (1100, []), (1200, [0.5]), (None, [1.0] * 6)]
    return out + out[:40] + [(100, [9.0] * 6)]


def test_against_all_pairs(spark):
    data = rows()
    df = spark.createDataFrame([(i, v, 1) for i, v in data], SCHEMA).repartition(5)
    for block in (4096, 3):  # several blocks of queries give the same
        got = sorted(tuple(r) for r in topk.exact_topk(df, F.col("vec_id") % 100 == 0, query_block=block).collect())
        assert got == brute(data, 10)


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0], 1), (5, [2.0], 1)], SCHEMA)
    assert [tuple(r) for r in topk.exact_topk(few, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 5, 1024 * 2048)]
    assert topk.exact_topk(few.where("vec_id < 0"), F.col("vec_id") % 100 == 0).collect() == []
