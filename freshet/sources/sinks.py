"""Writing tables, caches, summaries and run records.

All of it goes through Spark writers, so a path may be any file system the cluster knows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.config import PipelineConfig
from freshet.operators.climatology import LEVELS, climatology


def save_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """Parquet or CSV; the extension follows the format."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unsupported format {fmt!r}")
    path = path if path.endswith(f".{fmt}") else f"{path}.{fmt}"
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
    return path


def overwrite_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Write the partitions that ``df`` has rows for; the others in the table at ``path`` stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def cache_path(output_dir: str, name: str, cfg: PipelineConfig, *parts: str) -> str:
    """Location keyed by the configuration that determines the contents."""
    return f"{output_dir}/cache/{name}-{cfg.content_hash(*parts)[:16]}.parquet"


def content_key(df: DataFrame, columns: Sequence[str] | None = None) -> str:
    """A hash of a table's rows in any order, by one column-pruned aggregate: equal contents, equal key."""
    names = sorted(columns or df.columns)
    each = F.xxhash64(*[F.col(c) for c in names]).cast("decimal(20,0)")
    row = df.agg(F.count(F.lit(1)), F.sum(each), F.sum(F.xxhash64(F.lit(7), *[F.col(c) for c in names]).cast("decimal(20,0)"))).first()
    kinds = [(c, df.schema[c].dataType.simpleString()) for c in names]
    return hashlib.sha256(json.dumps([kinds, [str(v) for v in row]]).encode()).hexdigest()[:24]


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path`` if its write finished (the committer left its success marker)."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    files = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.parquet(path) if files.exists(marker) else None


def cached(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """Read ``path`` or build and write it. The result reads from files: lineage ends here."""
    found = None if force else read_if_there(spark, path)
    if found is not None:
        return found
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def clustered(df: DataFrame, entity: str, time: str, partitions: int | None = None) -> DataFrame:
    """Storage layout for series: rows of a series together and in time order.

    A very large series may be spread over several files by its own month, so that no single
    task writes it alone.
    """
    by = [F.col(entity), F.date_trunc("month", F.col(time))]
    spread = df.repartition(partitions, *by) if partitions else df.repartition(*by)
    return spread.sortWithinPartitions(entity, time)


def ensure_thresholds(
    series: DataFrame, out_dir: str, value: str = "precipitation", entity: str = "pixel_id", force: bool = False
) -> DataFrame:
    """Climatological thresholds, computed once for this input and kept with a description beside them.

    The file's name holds a hash of the value column, the entity, the levels and the rows they come from.
    """
    spark = series.sparkSession
    made_from = json.dumps([value, entity, LEVELS, content_key(series, [entity, value])], sort_keys=True)
    path = f"{out_dir}/thresholds-{hashlib.sha256(made_from.encode()).hexdigest()[:16]}.parquet"
    existed = None if force else read_if_there(spark, path)
    if existed is not None:
        return existed
    out = cached(spark, path, lambda: climatology(series, value, entity), force=True)
    note = {"description": "fixed climatological thresholds", "variable": value, "quantiles": LEVELS}
    write_json(spark, note, f"{out_dir}/thresholds_meta")
    return out


def write_json(spark: SparkSession, record: dict[str, Any], path: str, mode: str = "overwrite") -> None:
    """One JSON document as text (run records, reports)."""
    text = json.dumps(record, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)


def run_record(
    cfg: PipelineConfig, P: int, Q: int, model: str, features: list[str], metrics: dict, spark: SparkSession, **extra
) -> dict[str, Any]:
    """What is needed to repeat a run."""
    return {
        "P": P, "Q": Q, "model": model, "config": cfg.to_dict(), "config_hash": cfg.content_hash(),
        "feature_names": features, "metrics": metrics, "spark_version": spark.version, **extra,
    }


def append_summary(summary: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Stack result rows whose columns differ; missing ones become NULL."""
    return rows if summary is None else summary.unionByName(rows, allowMissingColumns=True)


def write_summary(summary: DataFrame, output_dir: str) -> str:
    """The summary has one row per (P, Q, model): one small CSV."""
    path = f"{output_dir}/summary_results.csv"
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of whole files, one task per file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))
