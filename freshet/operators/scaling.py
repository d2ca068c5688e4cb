"""Scalers fitted on training rows and applied as plain projections."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.quantiles import exact_percentiles

SCALERS = ("standard", "minmax", "robust")


@dataclass(frozen=True)
class Scaler:
    """Per column: ``(x - centre) / scale``. Two numbers per feature, held on the driver."""

    kind: str
    columns: tuple[str, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                for c, m, s in zip(self.columns, self.centre, self.scale)
            }
        )


def fit_scaler(train: DataFrame, columns: Sequence[str], kind: str = "standard") -> Scaler:
    """Fit on ``train`` in one aggregate. A zero spread scales by one."""
    columns = list(columns)
    if kind not in SCALERS:
        raise ValueError(f"unknown scaler {kind!r}; choose from {SCALERS}")
    if kind == "robust":
        stats = _quartiles(train, columns)
    else:
        a, b = (F.avg, F.stddev_pop) if kind == "standard" else (F.min, F.max)
        row = train.agg(*[f(F.col(c).cast("double")).alias(f"{t}{i}") for i, c in enumerate(columns) for t, f in (("a", a), ("b", b))]).first()
        stats = [(row[f"a{i}"], row[f"b{i}"]) for i in range(len(columns))]
        if kind == "minmax":
            stats = [(lo, None if hi is None else hi - lo) for lo, hi in stats]
    if any(m is None for m, _ in stats):
        raise ValueError("cannot fit a scaler on an empty or all-NULL column")
    return Scaler(kind, tuple(columns), tuple(m for m, _ in stats), tuple(s or 1.0 for _, s in stats))


def _quartiles(train: DataFrame, columns: list[str]) -> list[tuple[float, float]]:
    """(median, interquartile range) per column, exact at any size."""
    slim = train.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = slim.unpivot([], columns, "feature", "value")
    got = exact_percentiles(long, ["feature"], "value", {"a": 0.25, "m": 0.5, "b": 0.75})
    by = {r["feature"]: (r["a"], r["m"], r["b"]) for r in got.collect()}
    triples = [by.get(c, (None, None, None)) for c in columns]
    return [(None, None) if m is None else (m, b - a) for a, m, b in triples]
