"""Pruned nearest-neighbour search against all distances."""

import datetime
import re

import numpy as np
import pytest

from shelfseek.operators import clusters, nearest

DAY = datetime.datetime(2024, 1, 1)


def rows(rng, groups, each, spread, copies=0):
    """Vectors around random directions, copies of one, and vectors without a direction."""
    centres = rng.normal(size=(groups, 16))
    points = np.concatenate([c + spread * rng.normal(size=(each, 16)) for c in centres])
    points = np.concatenate([points, np.repeat(points[:1], copies, axis=0)])
    made = [(f"p{i}", [float(x) for x in v], DAY + datetime.timedelta(days=i % 5) if i % 7 else None)
            for i, v in enumerate(points)]
    return made + [("zero", [0.0] * 16, DAY), ("odd", [float("nan")] * 16, DAY), ("none", None, DAY)]


def brute(vectors, queries, k):
    known = [(i, np.float32(v).astype(float), at) for i, v, at in vectors if v is not None and np.isfinite(v).all() and any(v)]
    unit = np.array([v / np.linalg.norm(v) for _, v, _ in known])
    right = {}
    for q, v, _ in queries:
        if v is None or not np.isfinite(v).all() or not any(v):
            continue
        v = np.float32(v).astype(float)
        near = np.round(unit @ (v / np.linalg.norm(v)), 9)
        order = sorted(range(len(known)), key=lambda i: (
            -near[i], known[i][2] is None, -(known[i][2] or DAY).timestamp(), known[i][0]))[:k]
        right[q] = [(known[i][0], near[i]) for i in order]
    return right


@pytest.mark.parametrize("grid", [False, True])
@pytest.mark.parametrize("spread, copies", [(0.05, 0), (3.0, 0), (0.3, 120)])
def test_as_near_as_all_distances(spark, tmp_path, monkeypatch, grid, spread, copies):
    made = rows(np.random.default_rng(copies), 12, 40, spread, copies)
    if grid:
        monkeypatch.setattr(nearest, "MAX_QUERY_BLOCK", 7)
        monkeypatch.setattr(nearest, "CELL_VECTORS", 30)
    vectors = spark.createDataFrame(made, "product_id string, embedding array<float>, updated_at timestamp").repartition(5)
    good = vectors.filter("embedding is not null and product_id not in ('zero', 'odd')")
    lists = nearest.store(good, clusters.train(good, lists=10), str(tmp_path / "lists"))
    asked = [r for i, r in enumerate(made) if i % 17 == 0] + made[-3:]
    queries = spark.createDataFrame([r[:2] for r in asked], "q_id string, q_embedding array<float>")
    found = {}
    for r in sorted(nearest.search(queries, lists, good, 10).collect(), key=lambda r: r.rank):
        found.setdefault(r.q_id, []).append((r.product_id, r.similarity))
        if not copies:
            assert r.compared < len(made) / 4
    right = brute(made, asked, 10)
    assert {q: [i for i, _ in got] for q, got in found.items()} == {q: [i for i, _ in got] for q, got in right.items()}
    again = nearest.load(spark, str(tmp_path / "lists"))
    assert np.allclose(again.high, lists.high) and again.count.sum() == len(made) - 3


def test_tight_lists_are_left_out(spark, tmp_path):
    made = rows(np.random.default_rng(1), 12, 40, 0.05)[:-3]
    vectors = spark.createDataFrame(made, "product_id string, embedding array<float>, updated_at timestamp")
    lists = nearest.store(vectors, clusters.train(vectors, lists=12), str(tmp_path / "lists"))
    unit = clusters.unit_rows(np.array([made[0][1]]))
    assert 1 <= lists.visited(unit, np.array([0.9])).sum() <= 3
    plan = nearest._scan_local(lists, spark.createDataFrame(
        [("q", made[0][1], 0.9)], "q_id string, q_embedding array<float>, floor double").toArrow(), 10, False)
    assert re.search(r"PartitionFilters: \[[^\]]*list_no", plan._jdf.queryExecution().toString())


def test_empty(spark, tmp_path):
    made = rows(np.random.default_rng(1), 2, 5, 0.1)[:-3]
    vectors = spark.createDataFrame(made, "product_id string, embedding array<float>, updated_at timestamp")
    lists = nearest.store(vectors, clusters.train(vectors, lists=2), str(tmp_path / "lists"))
    none = spark.createDataFrame([], "q_id string, q_embedding array<float>")
    assert nearest.search(none, lists, vectors, 3).collect() == []
    few = spark.createDataFrame([("q", made[0][1])], "q_id string, q_embedding array<float>")
    assert len(nearest.search(few, lists, vectors, 50).collect()) == 10
