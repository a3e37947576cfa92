"""Every score by plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.llm.kd_search import build, top_k


def brute(rows, k=10):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in ok if i % 100 == 0}):
        v = min(v for i, v in ok if i == q)
        scored = sorted((-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard", [50, 100_000])
def test_against_loops(spark, shard):
    rng = random.Random(8)
    vec = lambda n=6: [float(np.float32(rng.gauss(0, .4))) for _ in range(n)]
    rows = [(i, vec()) for i in range(700)]
    rows += [(1000 + i, rows[5][1]) for i in range(120)]  # ties
    rows += [(1200, None), (1300, [None] * 6), (1400, [float("nan")] * 6), (1500, [float("inf")] * 6), (None, vec()), (1600, vec(3)), (1601, vec(3)), (1700, vec(2)), (1800, []), (1801, []),
             (1900, vec(1)), (-100, vec()), (7, vec()), (2000, [0.0] * 6), (2100, [3.0e30] * 6), (2101, [-3.0e30] * 6)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, n int").repartition(4)
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0, shard_rows=shard, block_queries=7).collect())
    rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute(rows)


def test_boxes_are_tight_and_leaves_small():
    points = np.floor(np.random.default_rng(0).normal(size=(1000, 5)) * 100)
    tree = build(np.arange(1000), points)
    assert sorted(tree.ids) == list(range(1000))
    for (first, end, left, _), low, high in zip(tree.nodes, tree.low, tree.high, strict=True):
        here = tree.points[first:end]
        assert (low == here.min(axis=0)).all() and (high == here.max(axis=0)).all()
        assert left >= 0 or end - first <= 64


def test_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(df, F.col("vec_id") % 100 == 0).collect() == []
    one = spark.createDataFrame([(100, [1.0])], "vec_id long, embedding array<float>")
    assert top_k(one, F.col("vec_id") % 100 == 0).collect() == []
