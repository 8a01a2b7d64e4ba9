"""Exact top-k against brute force with Python's whole numbers."""

import math
import random

import pytest

from tallywright.llm import topk


def brute(rows, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, own in {(i, tuple(v)) for i, v in usable if i % 50 == 0}:
        scored = [(-sum(a * b for a, b in zip(own, v)), i) for i, v in usable if i != q and len(v) == len(own)]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, id string")
    vectors = df.select(topk.F.col("vec_id").alias("id"), topk.whole_numbers(topk.F.col("embedding")).alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    return sorted(tuple(r) for r in topk.top_k(vectors, vectors.where("id % 50 = 0").distinct(), k).collect())


@pytest.mark.parametrize("scale", [1, 4e5, 1e12])
def test_against_brute_force(spark, monkeypatch, scale):
    """Several cells, shards and pages; scores within and beyond 2**53."""
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "BLOCK", 3)
    monkeypatch.setattr(topk, "PAGE", 8)
    rng = random.Random(int(scale))
    scale = min(scale, 1e6)  # scores must fit 64 bits
    centers = [[rng.uniform(-scale, scale) for _ in range(4)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, scale / 10) for c in rng.choice(centers)]) for i in range(400)]
    hot = rows[7][1]
    rows += [(i, hot) for i in range(400, 550)]  # one vector in many rows
    rows += [(50, rows[3][1]), (50, rows[3][1]), (100, hot), (100, hot), (9, hot), (9, hot), (9, hot)]  # repeated ids and rows
    rows += [(600, [1.0, 2.0]), (601, [3.0, -1.0]), (650, [0.0, 0.0]), (700, [1.5])]  # other lengths, too few
    rows += [(750, None), (800, []), (850, [float("nan")] * 4), (900, [1.0, None, 2.0, 3.0]), (950, [float("inf")] * 4), (None, hot)]
    assert found(spark, rows) == brute(rows, 5)


def test_large_components_keep_their_order(spark):
    rows = [(0, [1.0, 0.0]), (1, [3e5, 0.0]), (2, [4e5, 0.0]), (3, [2.0**40, 0.0]), (4, [2.0**40 + 2.0**-8, 0.0])]
    assert [r[2] for r in found(spark, rows)] == [4, 3, 2, 1]


def test_empty(spark):
    assert found(spark, []) == []
