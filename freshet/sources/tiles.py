"""Raster tiles to long series.

Input is a *tile table*, one row per band of a raster file::

    path string, band_idx int, band_desc string, height int, width int,
    crs string, transform array<double>, nodata double, values array<float>

(row-major values). Decoding image files into this table is left to a loader; from here on
everything is columnar. Bands of a time step are brought together while values are still
arrays, so the shuffle moves compact tiles; only then are arrays exploded into rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.config import TARGET_BAND
from freshet.functions.naming import band_name, band_time, file_time, has_band_name, month_start

TILE_SCHEMA = (
    "path string, band_idx int, band_desc string, height int, width int, crs string, "
    "transform array<double>, nodata double, values array<float>"
)
META_COLUMNS = ("crs", "transform", "height", "width", "nodata")


class AlignmentError(Exception):
    """Raster files do not share one grid."""


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NaN means missing in the files; SQL aggregates only skip NULL."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def list_files(files: DataFrame, max_files: int | None = None) -> DataFrame:
    """``(path, time)`` of the readable file names in time order, at most ``max_files``."""
    out = files.select("path").distinct().select("path", file_time("path").alias("time"))
    out = out.filter(F.col("time").isNotNull() & F.col("path").endswith(".tif"))
    out = out.orderBy("time", "path")
    return out if max_files is None else out.limit(max_files)


def list_directory(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """List ``*.tif`` of a folder without reading the contents."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(folder)
    return list_files(found.select("path"), max_files)


def file_metadata(tiles: DataFrame) -> DataFrame:
    """One row per file: grid description and number of bands.

    Where the bands of a file disagree, the least value stands for them, whatever the order of rows; see ``mixed_files``.
    """
    return tiles.groupBy("path").agg(
        *[F.min(c).alias(c) for c in META_COLUMNS], F.count(F.lit(1)).alias("count")
    )


def mixed_files(tiles: DataFrame) -> DataFrame:
    """``(path, issue)`` for every grid column in which the bands of one file differ."""
    mixed = [(c, ~F.min(c).eqNullSafe(F.max(c)) | ~F.count(c).isin(0, F.count(F.lit(1)))) for c in META_COLUMNS]
    found = tiles.groupBy("path").agg(F.array_compact(F.array(*[F.when(m, F.lit(f"{c} between bands")) for c, m in mixed])).alias("issues"))
    return found.select("path", F.explode("issues").alias("issue"))


def _literal(value) -> Column:
    return F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)


def alignment_issues(meta: DataFrame, columns: Sequence[str] = META_COLUMNS, reference: dict | None = None) -> DataFrame:
    """``(path, issue)`` for every difference from the first file (or from ``reference``)."""
    if reference is None:
        first = meta.orderBy(file_time("path").asc_nulls_last(), "path").first()
        if first is None:
            raise AlignmentError("no files to validate")
        reference = first.asDict()
    same = {c: F.col(c).eqNullSafe(_literal(reference[c])) for c in columns}
    tests = [(c, same[c]) for c in columns if c not in ("height", "width")]
    shape = [same[c] for c in ("height", "width") if c in same]
    if shape:
        agree = shape[0]
        for s in shape[1:]:
            agree = agree & s
        tests.append(("shape", agree))
    found = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in tests]))
    return meta.select("path", F.explode(found).alias("issue"))


def validate_alignment(tiles: DataFrame) -> None:
    """Raise with every kind of mismatch, its number of files and one of them; a clean table passes silently."""
    bad = alignment_issues(file_metadata(tiles)).union(mixed_files(tiles))
    rows = bad.groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("example")).collect()
    if rows:
        raise AlignmentError("; ".join(f"{r['issue']} differs in {r['n']} files, e.g. {r['example']}" for r in rows))


def _cells(tiles: DataFrame, layers: Sequence[str], stride: int, carry: Sequence[str]) -> DataFrame:
    """One row per kept cell of aligned value arrays: positions are chosen before anything is exploded."""
    width, size = F.col("width"), F.size(layers[0])
    rows = F.when(size > 0, F.sequence(F.lit(0), F.expr(f"(size(`{layers[0]}`) - 1) div width").cast("int"), F.lit(stride)))
    columns = F.sequence(F.lit(0), width.cast("int") - 1, F.lit(stride))
    nx = F.ceil(width / F.lit(stride)).cast("int")

    def cell(y: Column, x: Column) -> Column:
        at = (y * width + x).cast("int")
        yi, xi = (y / stride).cast("int"), (x / stride).cast("int")
        return F.struct(
            (yi.cast("long") * nx + xi).alias("pixel_id"), yi.alias("y_idx"), xi.alias("x_idx"),
            *[F.get(F.col(c), at).alias(c) for c in layers],
        )

    cells = F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: cell(y, x))))
    return tiles.select(*carry, F.explode(cells).alias("_cell")).select(
        *carry,
        *[F.col("_cell")[c].alias(c) for c in ("pixel_id", "y_idx", "x_idx")],
        *[F.col("_cell")[c].alias(c) for c in layers],
    )


def _steps(tiles: DataFrame, bands: Sequence[str], max_files: int | None) -> DataFrame:
    """One row per (file, time) with a value array per requested band.

    Named bands carry their own time; files without any named band hold hourly steps of one
    variable, starting at the file's time.
    """
    stamped = tiles.withColumn("_t0", file_time("path")).filter(F.col("_t0").isNotNull())
    if max_files is not None:
        stamped = stamped.join(F.broadcast(list_files(tiles, max_files).select("path")), "path", "left_semi")
    first = stamped.select("_t0", "path", "height", "width").orderBy("_t0", "path").first()
    if first is None:
        raise RuntimeError("no readable raster files")
    stamped = stamped.filter((F.col("height") == first["height"]) & (F.col("width") == first["width"]))
    named = stamped.groupBy("path").agg(F.bool_or(has_band_name("band_desc")).alias("_named"))
    single = TARGET_BAND if TARGET_BAND in bands else bands[0]
    hourly = F.col("_t0") + F.make_dt_interval(hours=F.col("band_idx"))
    labelled = stamped.join(named, "path").select(
        "path", "band_idx", "height", "width", "nodata", "values",
        F.when(F.col("_named"), band_time("band_desc")).otherwise(hourly).alias("time"),
        F.when(F.col("_named"), band_name("band_desc")).otherwise(F.lit(single)).alias("band"),
    )
    wanted = labelled.filter(F.col("time").isNotNull() & F.col("band").isin(list(bands)))
    empty = F.expr("transform(sequence(1, height * width), i -> cast(null as float))")
    return (
        wanted.groupBy("path", "time", "height", "width", "nodata")
        .agg(*[F.max_by(F.when(F.col("band") == b, F.col("values")), F.when(F.col("band") == b, F.col("band_idx"))).alias(b) for b in bands])
        .withColumns({b: F.coalesce(F.col(b), empty) for b in bands})
    )


def cube_rows(
    tiles: DataFrame, bands: Sequence[str] = (TARGET_BAND,), stride: int = 1, max_files: int | None = None
) -> DataFrame:
    """Every (time, cell) with a column per band; NULL where a band has no value."""
    bands = list(bands)
    rows = _cells(_steps(tiles, bands, max_files), bands, stride, ["time", "nodata"])
    clean = {
        b: F.when(~F.isnan(b) & ~F.coalesce(F.col(b) == F.col("nodata").cast("float"), F.lit(False)), F.col(b))
        for b in bands
    }
    return rows.withColumns(clean).drop("nodata")


def pixel_series(
    tiles: DataFrame, bands: Sequence[str] = (TARGET_BAND,), stride: int = 1, max_files: int | None = None
) -> DataFrame:
    """The long series table: rows with all bands present."""
    return cube_rows(tiles, bands, stride, max_files).dropna(subset=list(bands))


def value_grid(tiles: DataFrame, name: str = "p95", stride: int = 1, carry: Sequence[str] = ()) -> DataFrame:
    """One-band rasters as ``pixel_id, y_idx, x_idx, <name>`` (and the carried columns)."""
    return _cells(tiles.select(*carry, "width", F.col("values").alias(name)), [name], stride, carry)


def percentile_grids(layers: dict[str, DataFrame], stride: int = 1) -> DataFrame:
    """Threshold rasters side by side; every named layer must be there."""
    out = None
    for name, tiles in layers.items():
        if tiles.isEmpty():
            raise FileNotFoundError(f"percentile raster {name} is missing")
        grid = value_grid(tiles, name, stride)
        out = grid if out is None else out.join(grid.drop("y_idx", "x_idx"), "pixel_id")
    return out


def monthly_series(tiles: DataFrame, name: str = "precipitation", stride: int = 1) -> DataFrame:
    """Climatology scan: the file names a month, bands are its hours; bad names are left out."""
    start = month_start("path")
    steps = tiles.withColumn("_m", start).filter(F.col("_m").isNotNull()).select(
        (F.col("_m") + F.make_dt_interval(hours=F.col("band_idx"))).alias("time"),
        "width",
        F.col("values").alias(name),
    )
    return nan_to_null(_cells(steps, [name], stride, ["time"]), [name])


def roi_bounds(geojson: str | Path) -> tuple[float, float, float, float]:
    """(min lon, min lat, max lon, max lat) over all coordinates of a GeoJSON text or file."""
    text = str(geojson)
    doc = json.loads(text if text.lstrip().startswith("{") else Path(text).read_text())
    points: list[tuple[float, float]] = []

    def visit(node):
        if node and isinstance(node[0], (int, float)):
            points.append((node[0], node[1]))
        else:
            for child in node:
                visit(child)

    for feature in doc["features"]:
        visit(feature["geometry"]["coordinates"])
    lon, lat = zip(*points)
    return min(lon), min(lat), max(lon), max(lat)


def within_bounds(df: DataFrame, bounds: Sequence[float], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Range predicates on plain columns, so they reach the file scan."""
    lo_x, lo_y, hi_x, hi_y = bounds
    return df.filter(F.col(lon).between(lo_x, hi_x) & F.col(lat).between(lo_y, hi_y))


def select_period(df: DataFrame, start, end, rename: dict[str, str], time: str = "time", carry: Sequence[str] = ()) -> DataFrame:
    """Rows in [start, end) and the chosen variables under their short names."""
    from freshet.operators.climatology import instant

    rows = df.filter((F.col(time) >= instant(start)) & (F.col(time) < instant(end)))
    return rows.select(time, *carry, *[F.col(a).alias(b) for a, b in rename.items()])


def period_batches(df: DataFrame, start, end, days: int | None = 15, time: str = "time") -> DataFrame:
    """Tag rows of [start, end) with the consecutive batch they fall into.

    Batches are ``days`` long from ``start``, or calendar months when ``days`` is None; the last one
    is clipped to ``end``.
    """
    from freshet.operators.climatology import instant

    first, last, t = instant(start), instant(end), F.col(time)
    rows = df.filter((t >= first) & (t < last))
    if days is None:
        begin = F.date_trunc("month", t).cast("timestamp_ntz")
        nxt = F.add_months(begin.cast("date"), 1).cast("timestamp_ntz")
        begin = F.greatest(begin, first)
    else:
        seconds = F.timestamp_diff("SECOND", first, t)
        number = F.floor(seconds / F.lit(days * 86400)).cast("int")
        rows = rows.withColumn("_batch", number)
        begin = first + F.make_dt_interval(days=F.col("_batch") * days)
        nxt = first + F.make_dt_interval(days=(F.col("_batch") + 1) * days)
    out = rows.withColumns({"batch_start": begin, "batch_end": F.least(nxt, last)})
    return out.drop("_batch")


def metres_to_mm(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c) * 1000 for c in columns})


