"""Moments of blocks, folds as intervals, percentiles by narrowing, and owners of intermediate tables."""

import glob
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.config import SplitConfig, SplitStrategy
from freshet.operators import quantiles
from freshet.operators.gramian import Joint, MomentTree, moment_table, sparse_path
from freshet.operators.models import solve
from freshet.operators.search import fold_moments, search
from freshet.operators.splits import expanding_folds, purged_folds, rolling_folds
from freshet.operators.walkforward import _segments, interval_join, time_positions, walk_forward, walk_forward_intervals
from freshet.runtime import in_parallel, keep, pin, shared_folder, temporary
from tests.conftest import ntz


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(8)
    n = 400
    pdf = pd.DataFrame({"time": pd.Timestamp("2022-01-01") + pd.to_timedelta(rng.integers(0, 90, n), unit="D"), "a": rng.normal(50, 2, n), "b": rng.normal(size=n)})
    pdf["y"] = np.clip(0.3 + 0.02 * (pdf.a - 50) - 0.1 * pdf.b + rng.normal(0, 0.1, n), 0, 1)
    pdf.loc[::37, "a"] = np.nan
    return ntz(spark, pdf).withColumn("a", F.nanvl("a", F.lit(None).cast("double"))).cache(), pdf


def test_merged_moments_are_those_of_all_rows():
    rng = np.random.default_rng(0)
    x = rng.normal(1e6, 1, (90, 4))
    parts = [Joint.of(x[i : i + 9]) for i in range(0, 90, 9)]
    tree = MomentTree(dict(enumerate(parts)), 10)
    for first in range(10):
        for last in range(first, 10):
            rows = x[9 * first : 9 * (last + 1)]
            got = tree.run(first, last)
            assert got.n == len(rows) and np.allclose(got.mean, rows.mean(0), rtol=1e-14)
            assert np.allclose(got.products, (rows - rows.mean(0)).T @ (rows - rows.mean(0)), rtol=1e-6)
    assert MomentTree({}, 3).run(0, 2) is None


def test_blocks_of_the_moment_table(walk):
    df, pdf = walk
    got = moment_table(df.repartition(6), ["a", "b"], "y", F.day("time") % 3)
    for k, part in pdf.dropna().groupby(pdf.time.dt.day % 3):
        rows = part[["a", "b", "y"]].to_numpy()
        assert got[k].n == len(rows) and np.allclose(got[k].products, (rows - rows.mean(0)).T @ (rows - rows.mean(0)))


@pytest.mark.parametrize("folds_of", [
    lambda df: purged_folds(df, 4, 2, 1), lambda df: rolling_folds(df, SplitConfig(train_end="2022-02-01", val_end="2022-03-15", window_train_size=20, window_val_size=5)),
    lambda df: expanding_folds(df, SplitConfig(train_end="2022-02-01", val_end="2022-03-15", window_train_size=20, window_val_size=5, step_size=3)),
])
def test_training_moments_of_all_folds(walk, folds_of):
    df, pdf = walk
    folds = folds_of(df)
    got = fold_moments(df, folds, ["a", "b"], "y")
    assert len(got) == len(folds) > 2
    for f in folds:
        rows = pdf.dropna()[pdf.time.between(f.train_lo, f.train_hi)][["a", "b", "y"]].to_numpy()
        assert got[f.fold].n == len(rows) and np.allclose(got[f.fold].xx, np.cov(rows[:, :2].T, bias=True) * len(rows))


def test_paths_equal_single_descents(walk):
    from tests.test_models import coordinate_descent

    _, pdf = walk
    rows = pdf.dropna()
    x, y = rows[["a", "b"]].to_numpy(), rows.y.to_numpy()
    x = np.column_stack([x, x[:, 0] * 0.5 + x[:, 1], np.full(len(x), 3.0)])
    m = Joint.of(np.column_stack([x, y])).split()
    alphas = [0.01, 0.5, 0.0005, 0.05]
    for ratio in (1.0, 0.3):
        for alpha, (w, b) in zip(alphas, sparse_path(m, alphas, ratio)):
            def cost(v, alpha=alpha, ratio=ratio):
                gap = (y - y.mean()) - (x - x.mean(0)) @ v
                return gap @ gap / (2 * len(y)) + alpha * (ratio * np.abs(v).sum() + (1 - ratio) / 2 * v @ v)

            want = coordinate_descent(x[:, :3], y, alpha, ratio, 4000)
            assert cost(w) <= cost(np.append(want, 0.0)) + 1e-12 and w[3] == 0
            assert b == pytest.approx(y.mean() - x.mean(0) @ w)
    mixed = solve("ElasticNet", m, [{"alpha": 0.01, "l1_ratio": r, "max_iter": 5000} for r in (0.3, 1.0, 0.3)])
    assert np.array_equal(mixed[0][0], mixed[2][0]) and np.allclose(mixed[1][0], sparse_path(m, [0.01], 1.0)[0][0], atol=1e-9)


def test_linear_search_scores_as_fitting_does(walk):
    from freshet.operators import search as module

    df, _ = walk
    df = df.dropna()
    fast = search("ElasticNet", df, ["a", "b"], "y", "rmse", n_trials=3, n_folds=2)
    kept, module.LINEAR = module.LINEAR, ()
    try:
        slow = search("ElasticNet", df, ["a", "b"], "y", "rmse", n_trials=3, n_folds=2)
    finally:
        module.LINEAR = kept
    assert fast.best_params == slow.best_params
    a, b = ({r.trial: r.score for r in s.trials.collect()} for s in (fast, slow))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_dyadic_segments_cover_intervals_once(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *sorted(map(int, rng.integers(0, 300, 2)))) for i in range(60)] + [(60, 0, 256), (61, 5, 5), (62, 0, 1), (63, 1 << 33, (1 << 33) + 7)]
    intervals = spark.createDataFrame(rows, "fold int, low long, high long")
    pieces = _segments(intervals).toPandas()
    for fold, low, high in rows:
        mine = pieces[pieces.fold == fold]
        covered = sorted(p for s, k in zip(mine.segment, mine.level) for p in range(s << k, (s + 1) << k))
        assert covered == list(range(low, high)) and len(mine) <= 2 * max(1, (high - low).bit_length())
    at = spark.range(300).withColumnRenamed("id", "pos")
    got = {(r.pos, r.fold) for r in interval_join(at, intervals).collect()}
    assert got == {(p, f) for f, a, b in rows for p in range(a, min(b, 300))}
    assert interval_join(at, intervals.limit(0)).count() == 0


def test_many_folds_need_no_literals(spark):
    many = walk_forward_intervals(spark, 300_000, 2, 1, 3, False)
    assert many.count() == 2 * 99_999 + 2 and len(many._jdf.queryExecution().toString()) < 20_000
    assert walk_forward_intervals(spark, 4, 3, 2, 1, True).count() == 0


@pytest.mark.parametrize("strategy", [SplitStrategy.ROLLING, SplitStrategy.EXPANDING])
def test_walk_forward_equals_one_fit_per_fold(walk, strategy):
    df, pdf = walk
    cfg = SplitConfig(strategy=strategy, train_end="2022-02-01", val_end="2022-03-15", window_train_size=15, window_val_size=4, step_size=3)
    got = walk_forward(df, ["a", "b"], "y", cfg, (0.5, 20.0)).toPandas().set_index(["fold", "trial"])
    pdf = pdf.dropna()
    folds = (rolling_folds if strategy == SplitStrategy.ROLLING else expanding_folds)(df, cfg)
    assert len(got) == 2 * len(folds) > 20
    for f in folds:
        part, held = pdf[pdf.time.between(f.train_lo, f.train_hi)], pdf[pdf.time.between(f.val_lo, f.val_hi)]
        x, y = part[["a", "b"]].to_numpy(), part.y.to_numpy()
        for trial, alpha in enumerate((0.5, 20.0)):
            xc = x - x.mean(0)
            w = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ (y - y.mean()))
            p = np.clip((held[["a", "b"]].to_numpy() - x.mean(0)) @ w + y.mean(), 0, 1)
            row = got.loc[f.fold, trial]
            assert row.n == len(held) and row.rmse == pytest.approx(np.sqrt(np.mean((held.y - p) ** 2)), rel=1e-9)


def test_positions_are_dense(walk):
    df, pdf = walk
    got = time_positions(df).toPandas().sort_values("time")
    assert list(got.pos) == list(range(pdf.time.nunique())) and list(got.time) == sorted(pdf.time.unique())


@pytest.mark.parametrize("make", [
    lambda rng: rng.normal(size=1001), lambda rng: rng.integers(0, 3, 500).astype(float), lambda rng: np.full(70, 2.5),
    lambda rng: np.append(10.0 ** rng.uniform(-300, 300, 200), -1e308), lambda rng: np.append(rng.normal(size=50), [1e15, -1e15]), lambda rng: np.array([4.0]),
])
def test_percentiles_by_narrowing(spark, make):
    values = make(np.random.default_rng(3))
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 3, "v double").repartition(5)
    probs = [0.0, 0.05, 0.3, 0.5, 0.999, 1.0]
    got = quantiles.percentile_array(df, [], "v", probs).first().levels
    assert np.allclose(got, np.quantile(values, probs), rtol=1e-12, atol=0)


def test_percentiles_without_values(spark):
    none = spark.createDataFrame([(None,)], "v double")
    assert quantiles.exact_percentiles(none, [], "v", {"m": 0.5}).collect() == [(None,)]
    assert quantiles.exact_percentiles(none.limit(0), [], "v", {"m": 0.5}).count() == 0


def test_owners_delete_what_was_not_kept(spark):
    there = lambda: set(glob.glob(f"{shared_folder(spark)}/pinned-*"))
    before, df = there(), spark.range(5)
    with temporary(spark) as made:
        pin(df)
        in_parallel([lambda: pin(df), lambda: pin(df)], 2)
        with temporary(spark):
            pin(df)
            inner = keep(df)
        assert len(there() - before) == len(made) == 4 and inner.count() == 5
        out = keep(df)
    assert len(there() - before) == 1 and out.count() == 5
    with pytest.raises(ZeroDivisionError), temporary(spark):
        pin(df)
        math.floor(1 / 0)
    assert len(there() - before) == 1
