"""Neighbours by posting lists and rings agree with all pairs compared."""

from __future__ import annotations

import numpy as np
import pytest

from freshet.operators import neighbour_index as ni
from freshet.operators.models import fit_model
from freshet.operators.neighbours import knn_predict
from pyspark.sql import functions as F

COLS = ["a", "b", "c"]
KINDS = "id long, a double, b double, c double, y double, list int, v int"


def rows(spark, x, y=None, first=0):
    y = np.zeros(len(x)) if y is None else y
    return spark.createDataFrame([(first + i, *map(float, r), float(t), 0, 0) for i, (r, t) in enumerate(zip(x, y))], KINDS)


def brute(x, q, k, p):
    d = np.abs(q[:, None] - x[None]).sum(-1) if p == 1 else np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1))
    return [[(int(i), round(float(r[i]), 9)) for i in np.lexsort((np.arange(len(x)), r))[:k]] for r in d]


def found(index, spark, q, k=None):
    got = ni.search(index, rows(spark, q).select(ni.vector(COLS).alias("v")), k).collect()
    by = {}
    for r in got:
        by.setdefault(tuple(r.v), []).append((round(r.dist, 9), r.id))
    return [[(i, d) for d, i in sorted(by.get(tuple(map(float, v)), []))] for v in q]


@pytest.mark.parametrize("p", [1, 2])
def test_same_as_all_pairs(spark, p):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(8, 0.1, (200, 3)), rng.integers(0, 3, (200, 3))])
    q = np.concatenate([rng.normal(0, 2, (40, 3)), x[:20], x[-20:], [[50.0, 50.0, -50.0]]])
    index = ni.build_index(rows(spark, x), COLS, "id", "y", 5, p, lists=12, block_rows=20)
    assert index.blocks.count() > 20
    assert found(index, spark, q) == brute(x, q, 5, p)
    assert found(index, spark, q, 2) == brute(x, q, 2, p)


def test_a_third_of_all_rows_share_one_vector(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (600, 3))
    x[::3] = 0.25
    index = ni.build_index(rows(spark, x), COLS, "id", "y", 4, lists=8, block_rows=16)
    assert index.lists.rows.sum() == 404
    q = np.concatenate([np.full((200, 3), 0.25), rng.normal(0, 1, (10, 3))])
    assert found(index, spark, q) == brute(x, q, 4, 2)


def test_every_row_alike_and_fewer_rows_than_neighbours(spark):
    x = np.ones((3, 3))
    index = ni.build_index(rows(spark, x), COLS, "id", "y", 10, block_rows=2)
    assert found(index, spark, np.array([[1.0, 1, 1], [2, 1, 1]])) == [[(0, 0.0), (1, 0.0), (2, 0.0)], [(0, 1.0), (1, 1.0), (2, 1.0)]]
    with pytest.raises(ValueError):
        ni.search(index, rows(spark, x).select(ni.vector(COLS).alias("v")), 11)
    with pytest.raises(ValueError):
        ni.build_index(rows(spark, x), COLS, "nowhere", "y")


def test_missing_values_and_empty_tables(spark):
    known = spark.createDataFrame(
        [(1, 0.0, 0.0, 0.0, 1.0, 0, 0), (2, None, 0.0, 0.0, 9.0, 0, 0), (3, float("nan"), 0.0, 0.0, 9.0, 0, 0), (4, 0.0, float("inf"), 0.0, 9.0, 0, 0),
         (5, 0.0, 0.0, 0.0, None, 0, 0), (None, -0.0, 0.0, 1.0, 3.0, 0, 0)], KINDS)
    index = ni.build_index(known, COLS, "id", "y", 3)
    assert index.lists.rows.sum() == 2
    out = ni.indexed_predictions(index, known, COLS, 3, "uniform", "y").select("id", "y", "list").collect()
    got = {r.id: r.y for r in out}
    assert len(out) == 6 and got == {1: 2.0, 2: None, 3: None, 4: None, 5: 2.0, None: 2.0}
    assert ni.build_index(known.limit(0), COLS, "id", "y") is None
    assert ni.indexed_predictions(None, known, COLS, 3, "uniform", "p").filter("p is null").count() == 6
    assert ni.search(index, known.limit(0).select(ni.vector(COLS).alias("v"))).count() == 0


@pytest.mark.parametrize("weights", ["distance", "uniform"])
def test_predictions_do_not_depend_on_the_path(spark, weights):
    rng = np.random.default_rng(5)
    x, y = rng.normal(0, 1, (400, 3)), rng.uniform(0, 1, 400)
    train, test = rows(spark, x, y), rows(spark, np.concatenate([x[:20], rng.normal(0, 1, (60, 3))]))
    paths = [knn_predict(train, test, COLS, "id", "id", "y", 6, weights, max_rows=n).orderBy("id").toPandas() for n in (1000, 100)]
    assert list(paths[0].id) == list(paths[1].id)
    assert np.allclose(paths[0].y_pred, paths[1].y_pred, atol=1e-12)


def test_model_over_more_rows_than_a_task_gets(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(0, 1, (300, 3)), rng.uniform(0, 1, 300)
    df = rows(spark, x, y)
    small = fit_model("KNN", df, COLS, "y", n_neighbors=4, row_id=["id"])
    large = fit_model("KNN", df, COLS, "y", n_neighbors=4, row_id=["id"], max_rows=50)
    a, b = (m.predict(df.drop("y")).orderBy("id").toPandas() for m in (small, large))
    assert np.allclose(a.y_pred, b.y_pred, atol=1e-12)


def test_later_visits_hand_on_no_row_beyond_the_distance_reached(spark, monkeypatch):
    """What is sorted grows with the neighbours, not with the blocks that a query meets; many tasks share it."""
    rng = np.random.default_rng(8)
    x, q = rng.normal(0, 1, (900, 3)), rng.normal(0, 1, (50, 3))
    index = ni.build_index(rows(spark, x), COLS, "id", "y", 5, lists=6, block_rows=30)
    seen, visit = [], ni._visit
    monkeypatch.setattr(ni, "_visit", lambda *a: seen.append(visit(*a)) or seen[-1])
    monkeypatch.setattr(ni, "TASK_CANDIDATES", 10, raising=False)
    got = ni.search(index, rows(spark, q).select(ni.vector(COLS).alias("v")))
    assert got.rdd.getNumPartitions() > 25
    nearest = {tuple(map(float, v)): r[-1][1] for v, r in zip(q, brute(x, q, 5, 2))}
    first = {}
    for r in seen[0].collect():
        first.setdefault(tuple(r.v), []).append(r.dist)
    reached = {v: sorted(d)[4] if len(d) > 4 else np.inf for v, d in first.items()}
    later = seen[1].collect()
    assert later and all(r.dist <= reached[tuple(r.v)] + 1e-6 for r in later)
    assert found(index, spark, q) == brute(x, q, 5, 2) and len(nearest) == 50


def test_visits_of_one_ring_are_dealt_to_many_tasks(spark, monkeypatch):
    """However many queries meet a ring, a task gets a bounded number of them."""
    rng = np.random.default_rng(9)
    x, q = rng.normal(0, 1, (40, 3)), rng.normal(0, 1, (600, 3))
    index = ni.build_index(rows(spark, x), COLS, "id", "y", 3, lists=1, block_rows=40)
    for name, value in (("CHUNK", 8), ("HAND", 2), ("TASK_VISITS", 40)):
        monkeypatch.setattr(ni, name, value, raising=False)
    seen, visit = [], ni._visit
    monkeypatch.setattr(ni, "_visit", lambda *a: seen.append(visit(*a)) or seen[-1])
    assert found(index, spark, q) == brute(x, q, 3, 2)
    assert index.lists.rings.tolist() == [1]
    each = seen[0].groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("v").alias("n")).collect()
    assert sum(r.n for r in each) == 600 and max(r.n for r in each) < 150


def test_rows_are_dealt_evenly_before_they_are_sorted(spark, monkeypatch):
    """The tasks that sort the labelled rows are as many as the rows need, whatever partitions they come in."""
    x = np.random.default_rng(10).normal(0, 1, (300, 3))
    x[::3] = 0.5
    monkeypatch.setattr(ni, "TASK_ROWS", 10, raising=False)
    plans, pin = [], ni.pin
    monkeypatch.setattr(ni, "pin", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or pin(df))
    index = ni.build_index(rows(spark, x).coalesce(1), COLS, "id", "y", 4)
    assert "RepartitionByExpression [xxhash64(id" in plans[0] and "], 30" in plans[0]
    assert index.lists.rows.sum() == 204
    assert found(index, spark, x[:9]) == brute(x, x[:9], 4, 2)
