"""Scores, names, calendar and losses."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.functions import scores
from freshet.functions.calendar import cyclical, season
from freshet.functions.losses import loss
from freshet.functions.naming import band_name, band_time, file_time, month_start

X = (5.0, 10.0, 12.5, 15.0, 20.0, 25.0, 30.0)


def vp(spark, mode, xs=X, p=(10.0, 15.0, 25.0)):
    df = spark.createDataFrame([(i, x, *p) for i, x in enumerate(xs)], "i int, x double, a double, b double, c double")
    return [r.v for r in df.select("i", scores.vp("x", "a", "b", "c", mode).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("mode", ["piecewise", "sigmoid", "tanh"])
def test_anchors_and_monotone(spark, mode):
    got = vp(spark, mode)
    assert got[0] == got[1] == 0 and got[-1] == got[-2] == 1
    assert got[3] == pytest.approx(0.5)
    assert all(0 <= v <= 1 for v in got) and got == sorted(got)


def test_piecewise_values(spark):
    assert vp(spark, "piecewise") == pytest.approx([0, 0, 0.25, 0.5, 0.75, 1, 1])


def test_sigmoid_reaches_eps_at_p90(spark):
    assert vp(spark, "sigmoid", (10.0 + 1e-9,))[0] == pytest.approx(0.02, abs=1e-6)
    assert vp(spark, "tanh", (10.0 + 1e-9,))[0] == pytest.approx(0.02, abs=1e-6)


def test_flat_thresholds_and_extremes(spark):
    for mode in ("piecewise", "sigmoid", "tanh"):
        assert vp(spark, mode, (1e9, -1e9, 5.0), (5.0, 5.0, 5.0)) == [1.0, 0.0, 0.0]


@pytest.mark.parametrize("mode", ["piecewise", "sigmoid", "tanh"])
def test_missing_threshold_is_unknown_not_extreme(spark, mode):
    assert vp(spark, mode, (20.0, None), (None, 15.0, 25.0)) == [None, None]
    assert vp(spark, mode, (20.0,), (10.0, 15.0, None)) == [None]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        vp(spark, "cubic")


def test_strict_event_cut(spark):
    df = spark.createDataFrame([(0.2,), (0.5,), (0.51,), (0.9,)], "y double")
    assert [r.e for r in df.select(scores.is_event("y").alias("e")).collect()] == [0, 0, 1, 1]


def test_bands_of_intensity(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (0.7,), (1.0,), (None,)], "y double")
    got = [r.b for r in df.select(scores.intensity_band("y").alias("b")).collect()]
    assert got == ["below_p90", "p90_to_p95", "p95_to_p100", "above_p100", None]


def test_file_times(spark):
    names = {
        "x/era5_cube_20221201.tif": dt.datetime(2022, 12, 1),
        "era5_cube_20221201_14.tif": dt.datetime(2022, 12, 1, 14),
        "M12_D10_2024_H01_tp.tif": dt.datetime(2024, 12, 10, 1),
        "random_file.tif": None,
        "era5_cube_20221399.tif": None,
        "20221201_dir/other.tif": None,
    }
    df = spark.createDataFrame([(n,) for n in names], "path string").select("path", file_time("path").alias("t"))
    assert {r.path: r.t for r in df.collect()} == names


def test_times_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        # 00:00 did not exist that day in this zone.
        df = spark.createDataFrame([("era5_cube_20181104_00.tif",)], "path string")
        assert df.select(file_time("path").alias("t")).first().t == dt.datetime(2018, 11, 4)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_band_descriptions(spark):
    df = spark.createDataFrame([("M01_D02_2024_H03_t2m",), ("band 3",), (None,)], "d string")
    got = df.select(band_name("d").alias("b"), band_time("d").alias("t")).collect()
    assert [(r.b, r.t) for r in got] == [("t2m", dt.datetime(2024, 1, 2, 3)), (None, None), (None, None)]


def test_month_names(spark):
    df = spark.createDataFrame([("a/ERA_Precip_1995_02.tif",), ("Precip_x_y.tif",), ("p.tif",)], "p string")
    assert [r.t for r in df.select(month_start("p").alias("t")).collect()] == [dt.datetime(1995, 2, 1), None, None]


def test_calendar(spark):
    df = spark.createDataFrame([(dt.datetime(2022, 4, 1, 6),), (dt.datetime(2022, 12, 31, 18),)], "t timestamp_ntz")
    out = df.select(*[c.alias(n) for n, c in cyclical("t").items()], season("t").alias("s")).toPandas()
    assert out["hour_sin"].tolist() == pytest.approx([1.0, -1.0]) and out["month_sin"][0] == pytest.approx(1.0)
    assert out["doy_cos"][1] == pytest.approx(np.cos(2 * np.pi * 365 / 365.25))
    assert out["s"].tolist() == ["MAM_trans", "DJF_wet"]
    assert (out.drop(columns="s").abs() <= 1).all().all()


def test_losses(spark):
    y, p = np.array([0.0, 0.3, 1.0, 1.0]), np.array([0.1, 0.35, 0.6, 1.0])
    df = spark.createDataFrame(list(zip(map(float, y), map(float, p))), "y double, p double")
    got = df.agg(*[F.avg(loss(n, "y", "p")).alias(n) for n in ("mse", "bce", "focal", "huber")]).first()
    q = np.clip(p, 1e-7, 1 - 1e-7)
    bce = -(y * np.log(q) + (1 - y) * np.log(1 - q))
    p_t = y * q + (1 - y) * (1 - q)
    a = np.abs(p - y)
    assert got.mse == pytest.approx(np.mean((p - y) ** 2))
    assert got.bce == pytest.approx(bce.mean(), abs=1e-6)
    assert got.focal == pytest.approx(np.mean((y * 0.25 + (1 - y) * 0.75) * (1 - p_t) ** 2 * bce))
    assert got.huber == pytest.approx(np.mean(np.where(a < 0.1, a * a / 2, 0.1 * (a - 0.05))))
    with pytest.raises(ValueError):
        loss("l7", "y", "p")
