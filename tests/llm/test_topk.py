"""Exact top-k against brute force."""

import math
import random

import numpy as np
from oracle import compare
from pyspark.sql import functions as F

from segspark.llm import topk
from segspark.llm.queries import SQL, op1_topk

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    assert compare(op1_topk(spark, SF), SQL["op1_topk"], SF) > 0


def test_nra_keeps_the_best():
    rng = np.random.default_rng(1)
    for n, d in [(300, 3), (500, 16), (41, 2), (400, 1)]:
        x, q = rng.integers(-9, 9, (n, d)).astype(float), rng.integers(-9, 9, (20, d)).astype(float)
        q[0] = 0
        for (near, _), s in zip(topk.nra(x, q, 5), (x @ q.T).T):
            assert set(np.flatnonzero(s >= np.sort(s)[-5])) <= set(near.tolist())


def test_reads_little_where_few_stand_out():
    rng = np.random.default_rng(3)
    x = rng.integers(-9, 9, (4000, 8)).astype(np.float32)
    x[:5] = 200
    near, depth = zip(*topk.nra(x, np.abs(x[100:120]) + 1, 5))
    assert max(depth) <= 1000 and all(set(range(5)) <= set(v.tolist()) for v in near)


def test_wide_components(spark):
    """Sums that no double holds exactly are exact too."""
    rng = random.Random(4)
    rows = [(i, [rng.choice([-3e6, 1e6 + i % 7 / 256, 2e6, 5.0]) for _ in range(4)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.search(topk.quantized(df), F.col("vec_id") % 50 == 0).collect())
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    want = []
    for d, q in whole[::50]:
        best = sorted((-sum(a * b for a, b in zip(q, v)), e) for e, v in whole if e != d)[:5]
        want += [(d, i + 1, e, -s) for i, (s, e) in enumerate(best)]
    assert got == sorted(want)


def test_edges(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.7]) for _ in range(3)]) for i in range(300)]
    rows += [(400, None), (401, [0.1, None, 0.2]), (402, [math.nan] * 3), (403, [math.inf, 0.0, 0.0]), (404, []), (100, [0.7, 0.7, 0.7]), (None, [0.1] * 3), (450, [0.5, 0.5]), rows[50]]
    df = spark.createDataFrame([(d, v, "x") for d, v in rows], "vec_id long, embedding array<float>, row string")
    got = sorted(tuple(r) for r in topk.search(topk.quantized(df), F.col("vec_id") % 50 == 0, item_block=64, query_block=3).collect())
    ok = [(d, [math.floor(256 * float(np.float32(x))) for x in v]) for d, v in rows if d is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for d, q in ok:
        if d % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), e) for e, v in ok if e != d)[:5]
            want += [(d, i + 1, e, -s) for i, (s, e) in enumerate(best)]
    assert got == sorted(want)
    assert topk.search(topk.quantized(df.limit(0)), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(topk.quantized(df.where("vec_id = 50").limit(1)), F.col("vec_id") % 50 == 0).count() == 0
