"""Leakage and data-quality checks. Each check is an aggregate over the whole table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.config import SeriesKeys
from freshet.operators.features import FeatureSpec
from freshet.operators.ordering import ordered_view

# Words a feature name must not contain.
FUTURE_WORDS = ("target", "future", "label")
CORRELATION_LIMIT = 0.99


class CheckFailed(AssertionError):
    """A quality or leakage check did not hold."""


def suspicious_names(columns: Iterable[str], words: Sequence[str] = FUTURE_WORDS) -> list[str]:
    return [c for c in columns if any(w in c.lower() for w in words)]


def _rows(df: DataFrame, aggs: list[Column], structs: list[Column]) -> DataFrame:
    """Aggregate once, then turn the single row into one row per struct."""
    return df.agg(*aggs).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    aggs = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)]
    return _rows(
        df, aggs,
        [F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(columns)],
    )


def target_correlation(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson correlation of each feature with the target; undefined means no alert."""
    y = F.col(target).cast("double")
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        # ``corr`` divides by zero on a constant column in ANSI mode.
        spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
        aggs.append((F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))).alias(f"r{i}"))
    structs = []
    for i, c in enumerate(columns):
        r = F.col(f"r{i}")
        structs.append(
            F.struct(
                F.lit(c).alias("feature"),
                r.alias("correlation"),
                F.coalesce(F.abs(r) > CORRELATION_LIMIT, F.lit(False)).alias("alert"),
            )
        )
    return _rows(df, aggs, structs)


def lag_integrity(df: DataFrame, specs: Iterable[FeatureSpec], keys: SeriesKeys = SeriesKeys()) -> DataFrame:
    """Recompute every lag from the raw band and count rows that disagree (expected: none).

    Runs on the table that still holds the raw bands and on all its rows.
    """
    lags = [s for s in specs if s.kind == "lag" and s.band in df.columns]
    view = ordered_view(df, [keys.entity], keys.order, before=max((s.lag for s in lags), default=0))
    w = view.window()
    again = [F.lag(s.band, s.lag).over(w).alias(f"_a{i}") for i, s in enumerate(lags)]
    checked = view.finish(view.df.select("*", *again))
    aggs, structs = [], []
    for i, s in enumerate(lags):
        off = F.abs(F.col(s.name) - F.col(f"_a{i}")) > 1e-8 + 1e-5 * F.abs(F.col(f"_a{i}"))
        aggs += [F.count_if(off).alias(f"m{i}"), F.count(F.when(off.isNotNull(), 1)).alias(f"c{i}")]
        structs.append(
            F.struct(
                F.lit(s.name).alias("feature"),
                F.col(f"c{i}").alias("compared"),
                F.col(f"m{i}").alias("mismatches"),
            )
        )
    return _rows(checked, aggs, structs)


def duplicate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def check_battery(
    df: DataFrame,
    feature_cols: Sequence[str],
    target: str,
    masks: dict[str, Column],
    time: str = "time",
) -> DataFrame:
    """All checks in a single aggregate: rows ``(check, ok, detail)`` in order of severity.

    ``masks`` gives the boolean conditions of ``train``, ``val`` and ``test``.
    """
    m = {k: F.coalesce(v, F.lit(False)) for k, v in masks.items()}
    t = F.col(time)
    aggs = []
    for part in ("train", "val", "test"):
        aggs += [
            F.count_if(m[part]).alias(f"n_{part}"),
            F.min(F.when(m[part], t)).alias(f"lo_{part}"),
            F.max(F.when(m[part], t)).alias(f"hi_{part}"),
        ]
    for a, b in (("train", "val"), ("train", "test"), ("val", "test")):
        aggs.append(F.count_if(m[a] & m[b]).alias(f"both_{a}_{b}"))
    nulls = [F.count_if(F.col(c).isNull()) for c in feature_cols]
    total_nulls = nulls[0] if nulls else F.lit(0).cast("long")
    for n in nulls[1:]:
        total_nulls = total_nulls + n
    aggs += [total_nulls.alias("nulls"), F.min(target).alias("y_lo"), F.max(target).alias("y_hi")]

    bad_names = suspicious_names(feature_cols)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))

    def row(name: str, ok: Column, *detail: Column) -> Column:
        return F.struct(
            F.lit(name).alias("check"),
            F.coalesce(ok, F.lit(False)).alias("ok"),
            F.concat_ws(" ", *detail).alias("detail"),
        )

    structs = [
        row("no_future_names", F.lit(not bad_names), F.lit(",".join(bad_names))),
        row("train_before_val", F.col("hi_train") < F.col("lo_val"), text("hi_train"), text("lo_val")),
        row("val_before_test", F.col("hi_val") < F.col("lo_test"), text("hi_val"), text("lo_test")),
    ]
    for a, b in (("train", "val"), ("train", "test"), ("val", "test")):
        structs.append(row(f"disjoint_{a}_{b}", F.col(f"both_{a}_{b}") == 0, text(f"both_{a}_{b}")))
    for part in ("train", "val", "test"):
        structs.append(row(f"{part}_not_empty", F.col(f"n_{part}") > 0, text(f"n_{part}")))
    structs += [
        row("no_null_features", F.col("nulls") == 0, text("nulls")),
        row(
            "target_in_range",
            F.coalesce((F.col("y_lo") >= 0) & (F.col("y_hi") <= 1), F.lit(True)),
        ),
    ]
    return _rows(df, aggs, structs)


def split_masks(split_col: str = "split") -> dict[str, Column]:
    return {part: F.col(split_col) == part for part in ("train", "val", "test")}


def require(checks: DataFrame) -> None:
    """Raise on the first failed check (a handful of rows)."""
    for r in checks.collect():
        if not r["ok"]:
            raise CheckFailed(f"LEAKAGE or quality check {r['check']} failed: {r['detail']}")
