"""Exact top-k search against all products in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterlens.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def brute(rows, k, every=20):
    most = (1 << 63) - 1
    part = lambda x: max(-most - 1, min(most, math.floor(64 * x)))
    good = [(i, [part(x) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i is None or i % every:
            continue
        scores = [(-max(-most - 1, min(most, sum(x * y for x, y in zip(q, v)))), j is None, j or 0, j) for b, (j, v) in enumerate(good) if a != b]
        out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


def found(df, k, **kw):
    return sorted(map(tuple, topk.top_k(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0, k, **kw).collect()), key=str)


def _rows(n=700):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(12)], 0) for i in range(n)]
    rows += [(i, [0.5] * 6 + [-0.25] * 6, 0) for i in range(1000, 1150)]  # equal vectors: ties by id
    rows += [(20, [0.1] * 12, 0), (40, [0.2] * 12, 0), (40, [0.2] * 12, 0), (None, [0.3] * 12, 0), (None, [0.3] * 12, 0)]
    rows += [(60, None, 0), (80, [0.1, None], 0), (100, [float("nan")] * 12, 0), (120, [float("inf")] + [0.0] * 11, 0)]
    rows += [(2000, [], 0), (2020, [1.0, -1.0], 0), (2040, [0.5] * 20, 0), (2060, [0.0] * 12, 0)]
    return rows


@pytest.mark.parametrize("block, passes", [(512, 8192), (16, 7)])
def test_all_products(spark, monkeypatch, block, passes):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for c in ("id", "v", "q", "rank", "score", "block"):
        df = df.withColumn(c, F.lit("clash"))
    index = topk.build_index(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0)
    got = topk.search(index, 20, passes).select("query_id", "rank", "vec_id", "score")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 20)


def test_huge_weights(spark):
    rows = [(0, [1e10, 1e10], 0), (1, [1e10, -1e10], 0), (2, [1e17, 3.0], 0), (3, [-1e17, 1e300], 0), (20, [1e7, 1e7], 0), (5, [1e3, 1.0], 0)]
    assert found(spark.createDataFrame(rows, SCHEMA), 3) == brute(rows, 3)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0], 0), (20, [0.5, -1.0], 0), (7, [3.0, 1.0], 0)]
    assert found(spark.createDataFrame(rows, SCHEMA), 20) == brute(rows, 20)
    assert found(spark.createDataFrame([(7, [1.0], 0), (None, [1.0], 0)], SCHEMA), 5) == []
    assert found(spark.createDataFrame([(0, [1.0], 0)], SCHEMA), 5) == []
    assert found(spark.createDataFrame([], SCHEMA), 5) == []


def test_bounds_hold_and_prune(spark):
    """No score passes its block's bound, and blocks of clustered vectors are left out."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-60, 60, (20, 16))
    blocks = []
    for n, c in enumerate(centres):
        b = topk._Block.__new__(topk._Block)
        b.x = c + rng.integers(-3, 4, (50, 16))
        b.upper, b.lower, b.rows = b.x.max(axis=0), b.x.min(axis=0), n * 50 + np.arange(50)
        b.ids, b.no_id = b.rows, np.zeros(50, bool)
        blocks.append(b)
    q = centres[:5] + rng.integers(-3, 4, (5, 16))
    bounds = topk._bounds(q, blocks)
    assert all((topk._products(q, b.x).max(axis=1) <= bounds[:, n]).all() for n, b in enumerate(blocks))
    scored = []
    class Counting(topk._Best):
        def add(self, queries, *rest):
            scored.append(len(queries))
            super().add(queries, *rest)
    best = Counting(np.full(5, topk._LEAST), 10)
    best.add(*[np.repeat(np.arange(5), 10), np.full(50, -10**9), np.arange(50) + 10**6, np.zeros(50, bool)])
    best.settle()
    topk._search(blocks, np.full(5, -1), q, best)
    assert len(scored) < 60  # of 100 pairs of a query and a block
