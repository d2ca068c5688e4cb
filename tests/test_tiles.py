import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators.patches import build_patches
from freshet.sources import tiles
from freshet.sources.tiles import TILE_SCHEMA
from tests.conftest import ntz, rows_of

NODATA = -9.0


def tile(path, idx, desc, values, crs="EPSG:4326", nodata=NODATA):
    v = np.asarray(values, dtype=np.float32)
    return (path, idx, desc, v.shape[0], v.shape[1], crs, [1.0, 0.0], nodata, [float(x) for x in v.ravel()])


@pytest.fixture(scope="module")
def files(spark):
    g = lambda k: np.arange(15).reshape(3, 5) + 100 * k
    hole = g(4).astype(float)
    hole[0, 0], hole[2, 4] = NODATA, math.nan
    rows = [
        tile("d/era5_cube_20220102.tif", 0, "M01_D02_2022_H00_tp", g(1)),
        tile("d/era5_cube_20220102.tif", 1, "M01_D02_2022_H00_t2m", g(2)),
        tile("d/era5_cube_20220102.tif", 2, "M01_D02_2022_H01_tp", g(3)),
        tile("d/era5_cube_20220102.tif", 3, "M01_D02_2022_H01_t2m", hole),
        tile("d/era5_cube_20220102.tif", 4, "remark", g(5)),
        tile("d/era5_cube_20220103_06.tif", 0, "b0", g(6)),
        tile("d/era5_cube_20220103_06.tif", 1, "b1", g(7)),
        tile("d/era5_cube_20220104.tif", 0, "M01_D04_2022_H00_tp", np.ones((2, 2)), "EPSG:1"),
        tile("d/readme.tif", 0, "M01_D05_2022_H00_tp", g(8)),
    ]
    return spark.createDataFrame(rows, TILE_SCHEMA)


def test_single_band(files):
    got = rows_of(tiles.pixel_series(files, ("tp",)), "time", "pixel_id")
    assert set(got.time) == {dt.datetime(2022, 1, 2, h) for h in (0, 1)} | {dt.datetime(2022, 1, 3, h) for h in (6, 7)}
    assert len(got) == 4 * 15
    first = got[got.time == dt.datetime(2022, 1, 2)]
    assert first.tp.tolist() == list(range(100, 115)) and first.pixel_id.tolist() == list(range(15))
    assert first.y_idx.tolist() == [i // 5 for i in range(15)]


def test_two_bands_drop_incomplete_rows(files):
    got = rows_of(tiles.pixel_series(files, ("tp", "t2m")), "time", "pixel_id")
    assert got.groupby("time").size().tolist() == [15, 13]
    assert got.pixel_id[15:].tolist() == list(range(1, 14))


def test_cube_keeps_gaps(files):
    got = rows_of(tiles.cube_rows(files, ("tp", "t2m")), "time", "pixel_id")
    assert len(got) == 60 and got.t2m.isna().sum() == 2 + 30


@pytest.mark.parametrize("stride", [2, 3])
def test_stride(files, stride):
    got = rows_of(tiles.pixel_series(files, ("tp",), stride), "time", "pixel_id")
    want = (np.arange(15).reshape(3, 5) + 100)[::stride, ::stride]
    first = got[got.time == dt.datetime(2022, 1, 2)]
    assert first.tp.tolist() == want.ravel().tolist() and first.pixel_id.tolist() == list(range(want.size))


def test_max_files_and_errors(files):
    assert tiles.pixel_series(files, ("tp",), max_files=1).select("time").distinct().count() == 2
    with pytest.raises(RuntimeError):
        tiles.pixel_series(files.filter("path = 'd/readme.tif'"))


def test_listing(files):
    got = [(r.path[-6:-4], r.time) for r in tiles.list_files(files).collect()]
    assert got == [("02", dt.datetime(2022, 1, 2)), ("06", dt.datetime(2022, 1, 3, 6)), ("04", dt.datetime(2022, 1, 4))]
    assert tiles.list_files(files, 2).count() == 2


def test_directory_listing(spark, tmp_path):
    for n in ("era5_cube_20220102.tif", "x.tif", "era5_cube_20220101_05.tif", "a.txt"):
        (tmp_path / n).write_bytes(b"x")
    got = [r.time for r in tiles.list_directory(spark, str(tmp_path)).collect()]
    assert got == [dt.datetime(2022, 1, 1, 5), dt.datetime(2022, 1, 2)]


def test_alignment(files):
    meta = tiles.file_metadata(files)
    got = {(r.path[-12:], r.issue) for r in tiles.alignment_issues(meta).collect()}
    assert got == {("20220104.tif", "crs"), ("20220104.tif", "shape")}
    with pytest.raises(tiles.AlignmentError, match="crs.*|shape.*"):
        tiles.validate_alignment(files)
    tiles.validate_alignment(files.filter("path not like '%0104%'"))
    reference = {"crs": "EPSG:1", "height": 2, "width": 2}
    assert tiles.alignment_issues(meta, ("crs", "height", "width"), reference).count() == 6
    with pytest.raises(tiles.AlignmentError):
        tiles.validate_alignment(files.limit(0))


def test_nan_nodata_agrees_with_itself(spark):
    df = spark.createDataFrame([tile(f"era5_cube_2022010{i}.tif", 0, "", np.ones((1, 1)), nodata=math.nan) for i in (1, 2)], TILE_SCHEMA)
    tiles.validate_alignment(df)


def test_bands_of_one_file_that_disagree(spark):
    ones = np.ones((1, 2))
    rows = [tile("a_20220101.tif", 0, "", ones, crs="EPSG:2"), tile("a_20220101.tif", 1, "", ones, crs="EPSG:1"),
            tile("b_20220102.tif", 0, "", ones, nodata=None), tile("b_20220102.tif", 1, "", ones), tile("c_20220103.tif", 0, "", ones, nodata=None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, TILE_SCHEMA)
        assert [r.crs for r in tiles.file_metadata(df).orderBy("path").collect()] == ["EPSG:1", "EPSG:4326", "EPSG:4326"]
        got = {(r.path, r.issue) for r in tiles.mixed_files(df).collect()}
        assert got == {("a_20220101.tif", "crs between bands"), ("b_20220102.tif", "nodata between bands")}
        with pytest.raises(tiles.AlignmentError, match="crs between bands differs in 1 files"):
            tiles.validate_alignment(df)
    assert tiles.mixed_files(df.limit(0)).count() == 0


def test_threshold_grids(files):
    layer = files.filter("band_idx = 0 and path like '%0102%'")
    got = rows_of(tiles.percentile_grids({"p90": layer, "p95": layer, "p100": layer}, 2), "pixel_id")
    assert got.p95.tolist() == [100, 102, 104, 110, 112, 114] and got.x_idx.tolist() == [0, 1, 2] * 2
    with pytest.raises(FileNotFoundError):
        tiles.percentile_grids({"p90": layer, "p95": layer.limit(0)})


def test_monthly(spark):
    rows = [tile(f"x/P_1995_{m}.tif", b, "", np.full((1, 2), 10.0 * m + b)) for m in (1, 2) for b in range(3)]
    rows.append(tile("x/P_bad.tif", 0, "", np.ones((1, 2))))
    got = rows_of(tiles.monthly_series(spark.createDataFrame(rows, TILE_SCHEMA)), "time", "pixel_id")
    assert len(got) == 12 and got.time.max() == dt.datetime(1995, 2, 1, 2) and got.precipitation.max() == 22


def test_region_of_interest(spark, tmp_path):
    text = '{"features": [{"geometry": {"type": "Polygon", "coordinates": [[[-5, 1], [3, 2], [0, 8], [-5, 1]]]}}]}'
    (tmp_path / "roi.geojson").write_text(text)
    assert tiles.roi_bounds(text) == tiles.roi_bounds(tmp_path / "roi.geojson") == (-5, 1, 3, 8)
    df = spark.createDataFrame([(-6.0, 2.0), (-5.0, 8.0), (0.0, 0.5)], "lon double, lat double")
    assert tiles.within_bounds(df, tiles.roi_bounds(text)).count() == 1


def test_batches(spark):
    t = pd.date_range("2022-01-01", "2022-03-01", freq="6h")
    df = ntz(spark, pd.DataFrame({"time": t}))
    got = rows_of(tiles.period_batches(df, "2022-01-03", "2022-02-10", 15).groupBy("batch_start", "batch_end").count(), "batch_start")
    assert got.batch_start.dt.strftime("%m%d").tolist() == ["0103", "0118", "0202"]
    assert got.batch_end.dt.strftime("%m%d").tolist() == ["0118", "0202", "0210"] and got["count"].tolist() == [60, 60, 32]
    got = rows_of(tiles.period_batches(df, "2022-01-03", "2022-02-10", None).groupBy("batch_start", "batch_end").count(), "batch_start")
    assert got.batch_end.dt.strftime("%m%d").tolist() == ["0201", "0210"]


def test_select_and_units(spark):
    t = pd.date_range("2022-01-01", periods=4, freq="D")
    df = ntz(spark, pd.DataFrame({"time": t, "total": [0.001, 0.002, 0.003, 0.004], "other": 1}))
    got = rows_of(tiles.metres_to_mm(tiles.select_period(df, "2022-01-02", "2022-01-04", {"total": "tp"}), ["tp"]), "time")
    assert got.columns.tolist() == ["time", "tp"] and got.tp.tolist() == pytest.approx([2, 3])


def test_patches_match_numpy(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(5, 6, 6, 2)).astype(np.float32)
    t = pd.date_range("2022-01-01", periods=5, freq="h")
    rows = [(t[i].to_pydatetime(), y, x, float(data[i, y, x, 0]), float(data[i, y, x, 1])) for i in range(5) for y in range(6) for x in range(6)]
    cube = spark.createDataFrame(rows, "time timestamp_ntz, y_idx int, x_idx int, tp float, t2m float")
    cube = cube.withColumn("t2m", F.when(~((F.col("y_idx") == 0) & (F.col("x_idx") == 0)), F.col("t2m")))
    got = build_patches(cube, 2, 1, ["tp", "t2m"], 6, 6).collect()
    assert len(got) == 4 * 16
    data[:, 0, 0, 1] = np.nan
    for r in got:
        i = list(t).index(pd.Timestamp(r.time))
        want = data[i - 1 : i + 1, r.cy - 1 : r.cy + 2, r.cx - 1 : r.cx + 2]
        have = np.array([np.nan if v is None else v for v in r.patch], dtype=np.float32).reshape(want.shape)
        np.testing.assert_array_equal(have, want)
    only = spark.createDataFrame([(t[3].to_pydatetime(),)], "time timestamp_ntz")
    assert build_patches(cube, 2, 1, ["tp"], 6, 6, only).count() == 16


@pytest.mark.parametrize("hw, P, block", [(1, 2, 3), (2, 3, 4), (5, 3, 8), (5, 1, 32), (3, 2, 2)])
def test_patches_over_block_edges_and_holes(spark, hw, P, block):
    """Blocks smaller and larger than the halo; cells that are missing take their centres away."""
    rng = np.random.default_rng(hw)
    h, w, steps = 14, 17, 4
    cube = rng.normal(size=(steps, h, w)).astype(np.float32)
    gone = {(1, 3, 4), (2, 9, 16), (3, 0, 0)}
    rows = [(dt.datetime(2022, 1, 1, t), y, x, float(cube[t, y, x])) for t in range(steps) for y in range(h) for x in range(w) if (t, y, x) not in gone]
    df = spark.createDataFrame(rows, "time timestamp_ntz, y_idx int, x_idx int, tp float")
    got = {(r.time.hour, r.cy, r.cx): np.array(r.patch, np.float32) for r in build_patches(df, P, hw, ["tp"], h, w, block=block).collect()}
    want = {}
    for t in range(P - 1, steps):
        for y in range(hw, h - hw):
            for x in range(hw, w - hw):
                if not any(t - P < a <= t and abs(b - y) <= hw and abs(c - x) <= hw for a, b, c in gone):
                    want[t, y, x] = cube[t - P + 1 : t + 1, y - hw : y + hw + 1, x - hw : x + hw + 1].reshape(-1)
    assert got.keys() == want.keys() and all(np.array_equal(got[k], want[k]) for k in want)
