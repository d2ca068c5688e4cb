import numpy as np
import pandas as pd
import pytest

from freshet.config import FeatureConfig, FuzzyConfig, SampleMode, TargetMode
from freshet.operators import climatology as clim
from freshet.operators import features as feat
from freshet.operators import targets
from tests.conftest import ntz, rows_of

LAGS = FeatureConfig(bands=("tp", "t2m"), include_rolling=False, include_temporal=False, include_spatial_coords=False)


def brute(pdf, P, windows, stats):
    """Row-wise features of one frame, series by series."""
    out = []
    for _, g in pdf.sort_values(["pixel_id", "time"]).groupby("pixel_id"):
        g = g.reset_index(drop=True)
        for b in ("tp", "t2m"):
            for k in range(P):
                g[f"lag_{k}_{b}"] = g[b].shift(k)
            for w in windows:
                r = g[b].shift(1).rolling(w, min_periods=1)
                for s in stats:
                    if s == "trend":
                        past = [g[b][max(0, i - w):i].to_numpy() for i in range(len(g))]
                        g[f"roll_trend{w}_{b}"] = [np.polyfit(range(len(v)), v, 1)[0] if len(v) > 1 else np.nan for v in past]
                    else:
                        g[f"roll_{s}{w}_{b}"] = getattr(r, s)()
        out.append(g)
    return pd.concat(out, ignore_index=True)


def test_lag_columns(pixels):
    df, meta = feat.build_features(pixels, 3, LAGS)
    assert len(meta.names) == 6 and set(meta.names) == {f"lag_{k}_{b}" for k in range(3) for b in ("tp", "t2m")}
    got = df.toPandas()
    assert len(got) == 3 * 48 and not got.isna().any().any()


def test_all_features_match_brute_force(pixels):
    stats = ("mean", "std", "min", "max", "trend")
    cfg = FeatureConfig(bands=("tp", "t2m"), rolling_windows=(3, 6), rolling_stats=stats)
    df, meta = feat.build_features(pixels, 4, cfg)
    want = brute(pixels.toPandas(), 4, (3, 6), stats)
    names = [s.name for s in meta.specs if s.kind in ("lag", "roll")]
    want = want.dropna(subset=names).sort_values(["pixel_id", "time"]).reset_index(drop=True)
    got = rows_of(df, "pixel_id", "time")
    pd.testing.assert_frame_equal(got[names], want[names], check_dtype=False, atol=1e-9)


def test_rolling_does_not_cross_series(spark):
    """The first rows of a series never see the tail of the one before."""
    pdf = pd.DataFrame({
        "pixel_id": [0, 0, 0, 1, 1, 1], "tp": [1.0, 2, 3, 100, 200, 300],
        "time": list(pd.date_range("2022-01-01", periods=3, freq="h")) * 2,
    })
    cfg = FeatureConfig(bands=("tp",), rolling_windows=(3,), rolling_stats=("mean",), include_lags=False, include_temporal=False)
    got = rows_of(feat.build_features(ntz(spark, pdf), 1, cfg)[0], "pixel_id", "time")
    assert got["roll_mean3_tp"].tolist() == [1.0, 1.5, 100.0, 150.0]


def test_flags(pixels):
    with_time, meta = feat.build_features(pixels, 2, FeatureConfig(bands=("tp",)))
    assert {"hour_sin", "doy_cos", "y_idx", "x_idx"} <= set(with_time.columns)
    without, _ = feat.build_features(pixels, 2, LAGS)
    assert not {"hour_sin", "y_idx"} & set(without.columns)


def test_errors(pixels):
    with pytest.raises(ValueError):
        feat.build_features(pixels, 2, FeatureConfig(bands=("snow",)))
    with pytest.raises(ValueError):
        feat.build_features(pixels, 2, FeatureConfig(bands=("tp",), rolling_stats=("mode",)))
    with pytest.raises(ValueError):
        feat.build_features(pixels, 2, LAGS, SampleMode.REGION)
    with pytest.raises(NotImplementedError):
        feat.build_features(pixels, 2, LAGS, SampleMode.PATCH)


def test_null_entities_are_left_out(spark, pixels):
    extra = pixels.limit(5).withColumn("pixel_id", __import__("pyspark").sql.functions.lit(None).cast("long"))
    df, _ = feat.build_features(pixels.unionByName(extra), 2, LAGS)
    assert df.count() == 3 * 49


def test_region_features(pixels):
    region = pixels.withColumn("region", pixels.pixel_id % 2)
    cfg = FeatureConfig(bands=("tp",), rolling_windows=(3,), region_stats=("mean", "min", "max", "median"))
    df, meta = feat.build_features(region, 2, cfg, SampleMode.REGION, region_col="region")
    pdf = region.toPandas()
    agg = pdf.groupby(["region", "time"])["tp"].agg(["mean", "median"]).reset_index().sort_values(["region", "time"])
    agg["lag"] = agg.groupby("region")["mean"].shift(1)
    agg["med"] = agg.groupby("region")["median"].shift(1)
    got = rows_of(df, "region", "time").merge(agg, on=["region", "time"])
    assert np.allclose(got["lag_1_tp_mean"], got["lag"]) and np.allclose(got["lag_1_tp_median"], got["med"])
    assert len(got) == 2 * 48


def test_selection_for_a_shorter_lookback(pixels):
    cfg = FeatureConfig(bands=("tp",), rolling_windows=(3, 6))
    _, meta = feat.build_features(pixels, 6, cfg)
    names = [s.name for s in feat.select_for_lookback(meta.specs, 3)]
    assert "lag_2_tp" in names and "lag_3_tp" not in names
    assert "roll_mean3_tp" in names and "roll_mean6_tp" not in names and "hour_sin" in names


def test_sequence_order(pixels):
    df, meta = feat.build_features(pixels, 3, LAGS)
    row = df.select("*", feat.sequence_column(meta.specs).alias("new"), feat.sequence_column(meta.specs, True).alias("old")).first()
    assert row.new == [[row[f"lag_{k}_t2m"], row[f"lag_{k}_tp"]] for k in range(3)]
    assert row.old == row.new[::-1]


def test_targets_match_brute_force(pixels):
    thr = clim.climatology(pixels, "tp")
    out = rows_of(targets.add_targets(pixels, (1, 3), thr, FuzzyConfig(TargetMode.PIECEWISE)), "pixel_id", "time")
    pdf = pixels.toPandas().sort_values(["pixel_id", "time"]).reset_index(drop=True)
    for p, g in pdf.groupby("pixel_id"):
        lo, mid, hi = np.quantile(g.tp, 0.9), np.quantile(g.tp, 0.95), g.tp.max()
        for q in (1, 3):
            x = g.tp.shift(-q).to_numpy()
            want = np.interp(x, [lo, mid, hi], [0, 0.5, 1])
            got = out.loc[out.pixel_id == p, f"target_q{q}"].to_numpy()
            assert np.allclose(got[:-q], want[:-q]) and np.isnan(got[-q:]).all()
    summary = {r.Q: r for r in targets.target_summary(targets.add_targets(pixels, (1, 3), thr), (1, 3)).collect()}
    assert summary[1].n_valid == 147 and summary[3].n_valid == 141 and 0 < summary[1].n_above_05 < 30


def test_missing_thresholds_give_missing_targets(pixels):
    thr = clim.climatology(pixels.filter("pixel_id != 1"), "tp")
    out = targets.add_targets(pixels, (1,), thr).toPandas()
    assert out.loc[out.pixel_id == 1, "target_q1"].isna().all() and out.loc[out.pixel_id == 0, "target_q1"].notna().sum() == 49


def test_single_window_exchange(pixels):
    """Features and targets of any width need one exchange before the join with thresholds."""
    thr = pixels.select("pixel_id").distinct().selectExpr("pixel_id", "1d p90", "2d p95", "3d p100")
    df, _ = targets.features_and_targets(pixels, 12, FeatureConfig(bands=("tp", "t2m")), (1, 3), thr)
    plan = df._jdf.queryExecution().executedPlan().toString()
    left = plan[: plan.index("HashAggregate")] if "HashAggregate" in plan else plan
    assert left.count("Exchange hashpartitioning(pixel_id") == 1 and "BatchEvalPython" not in plan


def test_p95_lookup_and_train_cut(pixels):
    ext = clim.climatology(pixels.filter("pixel_id < 2"), "tp", levels={"p95": 0.95})
    out = clim.p95_lookup(pixels, external=ext).toPandas()
    assert out.loc[out.pixel_id == 2, "p95"].isna().all()
    with pytest.raises(ValueError):
        clim.p95_lookup(pixels)
    with pytest.raises(ValueError):
        clim.p95_lookup(pixels, method="other")
    before_all = clim.train_climatology(pixels, "tp", "1990-01-01").toPandas()
    assert before_all.p95.notna().all()  # empty cut falls back to everything
