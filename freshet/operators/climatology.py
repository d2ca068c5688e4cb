"""Per-series climatological thresholds and their alignment with rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators.quantiles import exact_percentiles

LEVELS = {"p90": 0.90, "p95": 0.95, "p100": 1.00}


def climatology(
    df: DataFrame, value: str, entity: str = "pixel_id", levels: dict[str, float] = LEVELS
) -> DataFrame:
    """Exact percentiles of each series over all time, one pass for all levels."""
    return exact_percentiles(df.dropna(subset=[entity]), [entity], value, levels)


def train_climatology(
    df: DataFrame, value: str, train_end, entity: str = "pixel_id", time: str = "time",
    levels: dict[str, float] = {"p95": 0.95},
) -> DataFrame:
    """Percentiles over rows up to ``train_end``; over everything when that cut is empty."""
    cut = df.filter(F.col(time) <= instant(train_end))
    return climatology(df if cut.isEmpty() else cut, value, entity, levels)


def instant(day, end_of_day: bool = False):
    """Literal timestamp without zone. A bare date is midnight, or its last microsecond."""
    if isinstance(day, str):
        day = dt.datetime.fromisoformat(day)
    elif not isinstance(day, dt.datetime):
        day = dt.datetime(day.year, day.month, day.day)
    if end_of_day:
        day = day.replace(hour=23, minute=59, second=59, microsecond=999999)
    return F.lit(day.isoformat(sep=" ")).cast("timestamp_ntz")


def align_thresholds(df: DataFrame, thresholds: DataFrame, entity: str = "pixel_id") -> DataFrame:
    """Left join of the thresholds onto every row.

    Thresholds have one row per series, so no hint is given: the optimizer broadcasts them
    when measured small, and splits a skewed series when they are not.
    """
    names = [c for c in thresholds.columns if c in (*LEVELS, entity)]
    return df.join(thresholds.select(*names), entity, "left")


def p95_lookup(
    df: DataFrame, value: str = "tp", method: str = "external", external: DataFrame | None = None,
    train: Column | None = None, entity: str = "pixel_id",
) -> DataFrame:
    """Attach a p95 per series, given from outside or taken from the training rows."""
    if method == "external":
        if external is None:
            raise ValueError("method='external' needs the external p95 table")
        return df.join(external.select(entity, "p95"), entity, "left")
    if method == "train":
        if train is None:
            raise ValueError("method='train' needs the training condition")
        own = climatology(df.filter(train), value, entity, {"p95": 0.95})
        return df.join(own, entity, "left")
    raise ValueError(f"unknown method {method!r}; external or train")


__all__ = ["LEVELS", "align_thresholds", "climatology", "instant", "p95_lookup", "train_climatology"]
