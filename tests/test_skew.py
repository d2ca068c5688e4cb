"""With limits so low that groups must be split, every ordered result stays the same."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.config import FeatureConfig, SplitConfig
from freshet.operators import alerts, climatology as clim, features as feat, metrics, quality, splits, targets
from freshet.operators.ordering import COPY, bucket_of, ordered_view, plan_slices, with_running_total
from freshet.operators.patches import build_patches
from freshet.operators.quantiles import exact_percentiles
from freshet.operators.scaling import fit_scaler
from tests.conftest import rows_of


def same(tight, make, *keys, **limits):
    plain = rows_of(make(), *keys)
    tight(**limits)
    split = rows_of(make(), *keys)
    pd.testing.assert_frame_equal(plain, split, check_exact=False, rtol=1e-9, atol=1e-9)
    return split


def test_plan(skewed, tight):
    assert not plan_slices(skewed, ["pixel_id"], "time").needed
    tight(task_rows=20)
    plan = plan_slices(skewed, ["pixel_id"], "time", reach=6)
    n = skewed.filter("pixel_id = 7").count()
    [(key, cuts, counts)] = plan.rows
    assert key == 7 and sum(counts) == n and len(counts) == len(cuts) + 1
    assert min(counts) >= 6 and max(counts) <= 40
    # The bound on cut points overrides the wish for short slices.
    tight(task_rows=1, max_slices=10)
    assert sum(len(r[-2]) for r in plan_slices(skewed, ["pixel_id"], "time").rows) <= 20


def test_halo_rows_are_few_and_removed(skewed, tight):
    tight(task_rows=20)
    view = ordered_view(skewed, ["pixel_id"], ["time"], before=3, after=2)
    copies = view.df.filter(COPY).count()
    slices = len(view.plan.rows[0][-1])
    assert copies == (slices - 1) * 5
    assert view.finish(view.df).count() == skewed.count()


@pytest.mark.parametrize("task_rows", [3, 20])
def test_features_and_targets(skewed, tight, task_rows):
    cfg = FeatureConfig(bands=("tp", "t2m"), rolling_windows=(3, 5), rolling_stats=("mean", "std", "min", "max", "trend"))
    make = lambda: targets.features_and_targets(skewed, 4, cfg, (1, 3), clim.climatology(skewed, "tp"))[0]
    out = same(tight, make, "pixel_id", "time", task_rows=task_rows)
    assert len(out) > 300


def test_past_lags_and_integrity(skewed, tight):
    same(tight, lambda: feat.past_lags(skewed, "tp", 4), "pixel_id", "time")
    cfg = FeatureConfig(bands=("tp",), include_rolling=False, include_temporal=False)
    df, meta = feat.build_features(skewed, 4, cfg, keep=("tp",))
    assert all(r.mismatches == 0 for r in quality.lag_integrity(df, meta.specs).collect())


def test_percentiles(spark, skewed, tight):
    holes = skewed.withColumn("tp", F.when(F.col("pixel_id") != 3, F.col("tp")))
    probs = {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.9, "e": 0.95, "f": 1.0}
    out = same(tight, lambda: exact_percentiles(holes, ["pixel_id"], "tp", probs), "pixel_id")
    assert out.loc[out.pixel_id == 3, list("abcdef")].isna().all().all() and len(out) == holes.select("pixel_id").distinct().count()


def test_global_percentiles(skewed, tight):
    probs = {f"p{i}": i / 40 for i in range(41)}
    tight(task_rows=5)
    got = exact_percentiles(skewed, [], "t2m", probs).first()
    want = np.quantile(skewed.toPandas().t2m, list(probs.values()))
    assert [got[k] for k in probs] == pytest.approx(want.tolist())


def test_region_median(skewed, tight):
    df = skewed.withColumn("r", F.col("pixel_id") % 2).withColumn("time", F.date_trunc("day", "time").cast("timestamp_ntz"))
    same(tight, lambda: feat.region_aggregate(df, ["tp"], "r"), "r", "time")


def test_robust_scaler(skewed, tight):
    plain = fit_scaler(skewed, ["tp", "t2m"], "robust")
    tight()
    split = fit_scaler(skewed, ["tp", "t2m"], "robust")
    assert split.centre == pytest.approx(plain.centre) and split.scale == pytest.approx(plain.scale)


def scored(skewed):
    y = F.pmod(F.xxhash64("time"), F.lit(100)) / 100
    p = F.pmod(F.xxhash64("time", "pixel_id"), F.lit(37)) / 37
    return skewed.select("pixel_id", y.alias("y_true"), p.alias("y_pred"))


@pytest.mark.parametrize("by", [(), ("pixel_id",)])
def test_ranking(skewed, tight, by):
    same(tight, lambda: metrics.ranking_metrics(scored(skewed), by=by), *by, task_rows=4)


@pytest.mark.parametrize("method", alerts.METHODS)
def test_calibration(skewed, tight, method):
    same(tight, lambda: alerts.calibrate(scored(skewed), method), task_rows=4)


def test_folds(skewed, tight):
    cfg = SplitConfig(val_end="2022-01-06")
    make = lambda: (splits.rolling_folds(skewed, cfg), splits.expanding_folds(skewed, cfg), splits.purged_folds(skewed, 3, 4))
    plain = make()
    tight(task_rows=9)
    assert make() == plain and plain[0] and plain[2]
    same(tight, lambda: splits.index_folds(skewed.select("time"), "time", 3), "fold", "time")


def test_running_total(spark, tight):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 5).alias("x"), F.lit("g").alias("g"))
    tight(task_rows=13)
    out = with_running_total(df, ["g"], "k", {"s": "x"}).orderBy("k").toPandas()
    assert (out.s == out.x.cumsum()).all() and list(out.k) == list(range(500))


def test_patches(spark, tight):
    cube = spark.range(40 * 16).select(
        (F.lit("2022-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") / 16).cast("int"))).alias("time"),
        (F.col("id") % 16 / 4).cast("int").alias("y_idx"), (F.col("id") % 4).cast("int").alias("x_idx"),
        F.col("id").cast("double").alias("tp"),
    )
    make = lambda: build_patches(cube, 3, 1, ["tp"], 4, 4).withColumn("patch", F.to_json("patch"))
    out = same(tight, make, "time", "cy", "cx", task_rows=6)
    assert len(out) == 38 * 4


def test_bucket_search(spark):
    cuts = sorted({round(float(x), 3) for x in np.random.default_rng(0).uniform(0, 1, 37)})
    xs = [-1.0, 2.0, *cuts, *[c + 1e-4 for c in cuts]]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.b for r in df.select(bucket_of(F.col("x"), F.array(*map(F.lit, cuts)), len(cuts)).alias("b")).collect()]
    assert got == np.searchsorted(cuts, xs, side="left").tolist()
