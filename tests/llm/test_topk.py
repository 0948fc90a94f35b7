"""Exact top-k against all pairs, with whole numbers."""

import math

import numpy as np

from skyframe.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, every, k):
    usable = [
        (i, n, [math.floor(1024 * float(np.float32(x))) for x in v])
        for n, (i, v) in enumerate(rows)
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, n, v in usable:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, m, w in usable if m != n and len(w) == len(v))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], start=1)]
    return sorted(out)


def found(spark, rows, every, k=10):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "0 AS score", "1 AS rank")
    return sorted(tuple(r) for r in topk.top_k(df, every, k).collect())


def test_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 90)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(2)
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(rng.standard_normal((600, 12)))]
    assert found(spark, rows, 20) == brute(rows, 20, 10)


def test_ties_repeats_and_odd_rows(spark):
    nan = float("nan")
    rows = [(i, [float(i % 3), 1.0]) for i in range(200)] + [(0, [2.0, 1.0]), (0, [2.0, 1.0]), (None, [9.0, 9.0]), (300, None), (301, [nan, 1.0])]
    rows += [(400, [1.0, None]), (500, []), (600, []), (700, [1.0, 2.0, 3.0]), (800, [float("inf"), 0.0])]
    assert found(spark, rows, 100) == brute(rows, 100, 10)


def test_few_candidates_and_none(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [-1.0])]
    assert found(spark, rows, 1) == brute(rows, 1, 10)
    assert found(spark, [], 1) == []


def test_large_numbers_stay_exact(spark):
    rows = [(i, [1e9 + 1e3 * i, -1e9 + 7e3 * i, 3.0]) for i in range(40)]
    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    assert found(spark, rows, 4) == [(q, r, j, min(s, (1 << 63) - 1)) for q, r, j, s in brute(rows, 4, 10)]


def test_box_bounds_hold():
    rng = np.random.default_rng(1)
    points = rng.integers(-500, 500, (300, 6)).astype(float)
    tree, queries = topk.Tree(np.arange(300), points), rng.integers(-500, 500, (20, 6)).astype(float)
    bounds = tree.bounds(queries)
    for node, rows in enumerate(tree.rows):
        if rows is not None:
            assert ((queries @ points[rows].T).max(1) <= bounds[:, node]).all()


def test_queries_of_all_lanes_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 20)
    rng = np.random.default_rng(3)
    rows = [(i, np.float32(v).tolist()) for i, v in enumerate(rng.standard_normal((600, 8)))]
    best = topk.top_k(spark.createDataFrame(rows, SCHEMA), 20)
    assert sorted(tuple(r) for r in best.collect()) == brute(rows, 20, 10)
    assert "BroadcastExchange" not in best._jdf.queryExecution().executedPlan().toString()
