"""Series and tiles derived from the given tables.

``event_series``: one series per user, irregular times, two bands.
``daily_series``: one series per supplier, one row per shipping day.
``vector_tiles``: every embedding is one band of an 8×8 raster file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.config import SeriesKeys, SplitConfig

EVENT_KEYS = SeriesKeys(tie=("event_id",))
DAY_KEYS = SeriesKeys()
EVENT_SPLIT = SplitConfig(train_end="2024-01-20", val_end="2024-01-25")
DAY_SPLIT = SplitConfig(train_end="1999-12-31", val_end="2000-12-31")
NODATA = -9999.0
FILE_BANDS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    return e.select(
        F.col("user_id").alias("pixel_id"),
        F.col("ts").alias("time"),
        "event_id",
        F.expr("cast(user_id div 16 as int)").alias("y_idx"),
        (F.col("user_id") % 16).cast("int").alias("x_idx"),
        F.col("value").alias("tp"),
        F.regexp_extract("props", r"(\d+)", 1).try_cast("double").alias("t2m"),
    )


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_suppkey").isNotNull() & F.col("l_shipdate").isNotNull())
    return li.groupBy(F.col("l_suppkey").alias("pixel_id"), F.col("l_shipdate").alias("time")).agg(
        F.sum("l_quantity").alias("tp"), F.avg("l_discount").alias("t2m")
    )


def with_region(spark: SparkSession, sf_dir: str, daily: DataFrame) -> DataFrame:
    """Region of each supplier through its nation."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    dim = s.join(n, s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("pixel_id"), F.col("n_regionkey").alias("region_id")
    )
    return daily.join(dim, "pixel_id")


def vector_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile table with named, unnamed, odd-shaped and odd-projection files."""
    v = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.expr(f"vec_id div {FILE_BANDS}").alias("f"), (F.col("vec_id") % FILE_BANDS).cast("int").alias("b")
    )
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.col("f").cast("int"))
    hour = F.lpad(F.expr("cast(b div 2 as string)"), 2, "0")
    unnamed, wide = F.col("f") % 5 == 4, F.col("f") % 7 == 3
    stem = F.concat(F.lit("grid/era5_cube_"), F.date_format(day, "yyyyMMdd"))
    values = F.transform(
        "embedding", lambda x: F.when(F.abs(x) < 0.005, F.lit(NODATA)).otherwise(x).cast("float")
    )
    return v.select(
        F.concat(stem, F.when(unnamed, "_06.tif").otherwise(".tif")).alias("path"),
        F.col("b").alias("band_idx"),
        F.when(unnamed, F.concat(F.lit("band "), F.col("b").cast("string")))
        .otherwise(F.concat(F.date_format(day, "'M'MM'_D'dd'_'yyyy'_H'"), hour, F.when(F.col("b") % 2 == 0, "_tp").otherwise("_t2m")))
        .alias("band_desc"),
        F.when(wide, 4).otherwise(8).alias("height"),
        F.when(wide, 16).otherwise(8).alias("width"),
        F.when(F.col("f") % 11 == 5, "EPSG:31983").otherwise("EPSG:4326").alias("crs"),
        F.array(*[F.lit(x) for x in (-53.6, 0.25, 0.0, -19.3, 0.0, -0.25)]).alias("transform"),
        F.lit(NODATA).alias("nodata"),
        values.alias("values"),
    )


def monthly_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rasters as monthly climatology files; every ninth name carries no month."""
    v = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.expr(f"vec_id div {FILE_BANDS}").alias("f"), (F.col("vec_id") % FILE_BANDS).cast("int").alias("b")
    )
    month = F.add_months(F.lit("1995-01-01").cast("date"), F.col("f").cast("int"))
    name = F.when(F.col("f") % 9 == 8, F.concat(F.lit("Precip_part_x"), F.col("f").cast("string"), F.lit(".tif"))).otherwise(
        F.concat(F.lit("Precip_"), F.date_format(month, "yyyy_MM"), F.lit(".tif"))
    )
    return v.select(
        name.alias("path"), F.col("b").alias("band_idx"), F.lit("").alias("band_desc"), F.lit(8).alias("height"),
        F.lit(8).alias("width"), F.lit("EPSG:4326").alias("crs"), F.array(F.lit(0.0)).alias("transform"),
        F.lit(None).cast("double").alias("nodata"), F.col("embedding").alias("values"),
    )


def stamped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names in all three styles, and unreadable ones, from the orders table."""
    o = table(spark, sf_dir, "orders")
    ymd, hour = F.date_format("o_orderdate", "yyyyMMdd"), F.lpad((F.col("o_custkey") % 24).cast("string"), 2, "0")
    style = F.col("o_orderkey") % 4
    path = (
        F.when(style == 0, F.concat(F.lit("cube/era5_cube_"), ymd, F.lit(".tif")))
        .when(style == 1, F.concat(F.lit("era5_cube_"), ymd, F.lit("_"), hour, F.lit(".tif")))
        .when(style == 2, F.concat(F.lit("a/b/"), F.date_format("o_orderdate", "'M'MM'_D'dd'_'yyyy'_H'"), hour, F.lit("_"), F.lower(F.substring("o_orderpriority", 3, 3)), F.lit(".tif")))
        .otherwise(F.concat(F.lit("random_file_"), (F.col("o_orderkey") % 7).cast("string"), F.lit(".tif")))
    )
    return o.select("o_orderkey", path.alias("path"))
