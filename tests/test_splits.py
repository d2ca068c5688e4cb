
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.config import SplitConfig, SplitStrategy
from freshet.operators import quality, scaling, splits
from freshet.operators.features import lag_specs
from tests.conftest import ntz

CFG = SplitConfig(train_end="2022-12-31", val_end="2023-02-28")


@pytest.fixture(scope="module")
def days(spark):
    t = pd.date_range("2022-01-01", "2023-06-30")
    return ntz(spark, pd.DataFrame({"time": t, "val": np.arange(len(t), dtype=float)}))


def test_fixed(days):
    out = splits.make_splits(days, CFG).toPandas()
    n = out.groupby("split").size()
    assert n.sum() == 546 and n["train"] == 365 and n["val"] == 59
    hi, lo = out.groupby("split")["time"].max(), out.groupby("split")["time"].min()
    assert hi["train"] < lo["val"] and hi["val"] < lo["test"]
    assert [f.count() for f in splits.split_frames(days, CFG)] == [365, 59, 122]


def test_cut_dates_are_midnight(spark):
    df = ntz(spark, pd.DataFrame({"time": pd.to_datetime(["2022-12-31 00:00", "2022-12-31 01:00", "2023-02-28 05:00"])}))
    label = lambda cfg: [r.split for r in splits.fixed_split(df, cfg).orderBy("time").collect()]
    assert label(CFG) == ["train", "val", "test"]
    assert label(SplitConfig(train_end="2022-12-31", val_end="2023-02-28", end_of_day=True)) == ["train", "train", "val"]


def test_null_time_has_no_split(spark):
    df = spark.createDataFrame([(None,)], "time timestamp_ntz")
    assert splits.fixed_split(df, CFG).first().split is None


def spans(n, tw, vw, step, growing):
    out, s = [], 0
    while s + tw + vw <= n:
        out.append((0 if growing else s, s + tw, s + tw, s + tw + vw))
        s += step
    return out


@pytest.mark.parametrize("growing", [False, True])
@pytest.mark.parametrize("sizes", [(None, None, None), (100, 30, 17)])
def test_walk_forward(days, growing, sizes):
    tw, vw, step = sizes
    cfg = SplitConfig(SplitStrategy.EXPANDING if growing else SplitStrategy.ROLLING, CFG.train_end, CFG.val_end, tw, vw, step)
    folds = splits.make_splits(days, cfg)
    times = pd.date_range("2022-01-01", "2023-02-28")
    n = len(times)
    tw, vw = tw or n // 3, vw or n // 6
    want = spans(n, tw, vw, step or vw, growing)
    got = [(f.train_lo, f.train_hi, f.val_lo, f.val_hi) for f in folds]
    assert got == [(times[a], times[b - 1], times[c], times[d - 1]) for a, b, c, d in want]


def test_no_folds_warns(days):
    with pytest.warns(UserWarning):
        assert splits.rolling_folds(days, SplitConfig(val_end="2022-01-05", window_train_size=50, window_val_size=5)) == []
    assert splits.assign_folds(days, []).count() == 0


@pytest.mark.parametrize("gap", [0, 5])
def test_purged(spark, gap):
    t = np.repeat(pd.date_range("2022-01-01", periods=200), 3)
    df = ntz(spark, pd.DataFrame({"time": t}))
    folds = splits.purged_folds(df, 3, gap)
    member = splits.assign_folds(df, folds).toPandas()
    previous = 0
    assert len(folds) == 3
    for f in folds:
        part = member[member.fold == f.fold]
        train, val = (set(part[part.role == r].time) for r in ("train", "val"))
        assert not train & val and (min(val) - max(train)).days == gap + 1
        assert len(part[part.role == "train"]) == 3 * 50 * f.fold > previous
        previous = len(part[part.role == "train"])
    assert len(set(member[(member.fold == 3) & (member.role == "val")].time)) == 50 - gap  # clipped at the end


def test_purged_drops_thin_folds(spark):
    df = ntz(spark, pd.DataFrame({"time": pd.date_range("2022-01-01", periods=300)}))
    assert [f.fold for f in splits.purged_folds(df, 3)] == [2, 3]  # the first has 75 training rows


def test_index_folds(spark):
    df = spark.range(103).withColumn("k", F.col("id") * 7)
    got = splits.index_folds(df, "k", 3).groupBy("fold", "role").agg(F.min("id"), F.max("id")).collect()
    size = 103 // 4
    want = {(k, "train"): (0, k * size - 1) for k in (1, 2, 3)} | {(k, "val"): (k * size, (k + 1) * size - 1) for k in (1, 2, 3)}
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == want


def test_spatial(spark, pixels):
    out = splits.spatial_holdout(pixels, "pixel_id", [1])
    assert out.filter("holdout").count() == 50 and out.filter("not holdout").count() == 100
    inside, held = splits.spatial_holdout_by(pixels, "pixel_id", spark.createDataFrame([(1,)], "pixel_id long"))
    assert (inside.count(), held.count()) == (100, 50)


@pytest.mark.parametrize("kind", ["standard", "minmax", "robust"])
def test_scalers(spark, kind):
    train = spark.createDataFrame([(1.0, 10.0, 5.0), (2.0, 20.0, 5.0), (3.0, 30.0, 5.0)], "a double, b double, c double")
    test = spark.createDataFrame([(4.0, 40.0, 5.0), (5.0, 50.0, 6.0)], "a double, b double, c double")
    s = scaling.fit_scaler(train, ["a", "b", "c"], kind)
    got = s.transform(test).toPandas()
    x = np.array([1.0, 2, 3])
    m, d = {"standard": (x.mean(), x.std()), "minmax": (1.0, 2.0), "robust": (2.0, 1.0)}[kind]
    assert got.a.tolist() == pytest.approx([(4 - m) / d, (5 - m) / d]) and got.b.tolist() == pytest.approx(got.a.tolist())
    assert got.c.tolist() == [0.0, 1.0]
    with pytest.raises(ValueError):
        scaling.fit_scaler(train, ["a"], "log")


def checked(spark):
    t = pd.date_range("2022-01-01", periods=30)
    return ntz(spark, pd.DataFrame({"time": t, "i": range(30), "feat_1": np.arange(30.0), "y": np.linspace(0, 1, 30)}))


def masks(a, b, c):
    return dict(zip(("train", "val", "test"), (F.expr(a), F.expr(b), F.expr(c))))


def test_battery_passes(spark):
    quality.require(quality.check_battery(checked(spark), ["feat_1"], "y", masks("i < 10", "i between 10 and 19", "i >= 20")))


@pytest.mark.parametrize(
    "cols, m, y, check",
    [
        (["feat_1"], ("i < 15", "i between 10 and 19", "i >= 20"), "y", "disjoint_train_val"),
        (["feat_1"], ("i < 15", "i between 10 and 19", "i >= 20"), "y", "train_before_val"),
        (["feat_1"], ("i < 0", "i between 10 and 19", "i >= 20"), "y", "train_not_empty"),
        (["target_lag"], ("i < 10", "i between 10 and 19", "i >= 20"), "y", "no_future_names"),
        (["holes"], ("i < 10", "i between 10 and 19", "i >= 20"), "y", "no_null_features"),
        (["feat_1"], ("i < 10", "i between 10 and 19", "i >= 20"), "feat_1", "target_in_range"),
    ],
)
def test_battery_fails(spark, cols, m, y, check):
    df = checked(spark).withColumn("target_lag", F.lit(1.0)).withColumn("holes", F.when(F.col("i") > 3, 1.0))
    out = quality.check_battery(df, cols, y, masks(*m))
    assert check in [r["check"] for r in out.collect() if not r.ok]
    with pytest.raises(quality.CheckFailed, match="LEAKAGE"):
        quality.require(out)


def test_correlation_alert(spark):
    out = {r.feature: r for r in quality.target_correlation(checked(spark).withColumn("c", F.lit(2.0)), ["feat_1", "c"], "y").collect()}
    assert out["feat_1"].alert and out["feat_1"].correlation == pytest.approx(1) and not out["c"].alert


def test_lag_integrity_finds_damage(pixels):
    from freshet.config import FeatureConfig
    from freshet.operators.features import build_features

    cfg = FeatureConfig(bands=("tp",), include_rolling=False, include_temporal=False, include_spatial_coords=False)
    df, meta = build_features(pixels, 3, cfg, keep=("tp",))
    good = quality.lag_integrity(df, meta.specs).collect()
    assert all(r.mismatches == 0 and r.compared > 0 for r in good)
    bad = df.withColumn("lag_1_tp", F.when(F.col("pixel_id") == 1, F.col("lag_2_tp")).otherwise(F.col("lag_1_tp")))
    assert {r.feature for r in quality.lag_integrity(bad, lag_specs(["tp"], 3)).collect() if r.mismatches} == {"lag_1_tp"}


def test_duplicate_keys(spark):
    df = spark.createDataFrame([(1, 2), (1, 2), (1, 3)], "a int, b int")
    assert [tuple(r) for r in quality.duplicate_keys(df, ["a", "b"]).collect()] == [(1, 2, 2)]
