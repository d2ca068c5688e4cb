"""Time splits, walk-forward folds and spatial holdout.

Folds are contiguous in the sorted distinct times, so a fold is four bounds. Only the number
of distinct times and the times at the bounds reach the driver; rows are assigned by a
projection over the literal bounds, without a join.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.config import SplitConfig, SplitStrategy
from freshet.operators.climatology import instant
from freshet.operators.ordering import with_running_total
from freshet.runtime import keep, temporary, unpin

SPLIT = "split"


@dataclass(frozen=True)
class Fold:
    """Inclusive bounds; ``None`` on either side of validation never occurs."""

    fold: int
    train_lo: Any
    train_hi: Any
    val_lo: Any
    val_hi: Any


def fixed_split(df: DataFrame, cfg: SplitConfig, time: str = "time") -> DataFrame:
    """Label rows train / val / test by the two cut instants; NULL times stay unlabelled."""
    return df.withColumn(SPLIT, split_label(cfg, time))


def split_label(cfg: SplitConfig, time: str = "time") -> Column:
    t = F.col(time)
    first, second = instant(cfg.train_end, cfg.end_of_day), instant(cfg.val_end, cfg.end_of_day)
    return F.when(t <= first, "train").when(t <= second, "val").when(t > second, "test")


def distinct_times(df: DataFrame, time: str = "time") -> DataFrame:
    return df.select(F.col(time).alias("time")).dropna().distinct()


class TimeIndex:
    """Dense 0-based positions of distinct values, ranked once and kept as a table."""

    def __init__(self, values: DataFrame, column: str = "time"):
        self.column = column
        with temporary(values.sparkSession):
            ranked = with_running_total(values.withColumn("_one", F.lit(1)), [], column, {"_pos": "_one"})
            self.ranked = keep(ranked.select("_pos", column))
        self.n = self.ranked.count()

    def at(self, positions: Iterable[int]) -> dict[int, Any]:
        """Values at the given positions; only those reach the driver."""
        wanted = sorted(set(positions))
        hit = self.ranked.filter(F.col("_pos").isin([p + 1 for p in wanted])) if wanted else self.ranked.limit(0)
        return {r["_pos"] - 1: r[self.column] for r in hit.collect()}


def _resolve(index: TimeIndex, spans: Sequence[tuple[int, int, int, int]]) -> list[Fold]:
    """Turn half-open index spans (train lo, hi, val lo, hi) into time bounds; the index is done with then."""
    at = index.at(p for a, b, c, d in spans for p in (a, b - 1, c, d - 1))
    unpin(index.ranked)
    return [
        Fold(i + 1, at[a], at[b - 1], at[c], at[d - 1]) for i, (a, b, c, d) in enumerate(spans)
    ]


def test_rows(cfg: SplitConfig, time: str = "time") -> Column:
    """Rows after the test cut: held out from every fold of the walk-forward strategies."""
    return F.coalesce(F.col(time) > instant(cfg.val_end, cfg.end_of_day), F.lit(False))


def _walk_forward(df: DataFrame, cfg: SplitConfig, time: str, growing: bool) -> list[Fold]:
    before_test = df.filter(F.col(time) <= instant(cfg.val_end, cfg.end_of_day))
    index = TimeIndex(distinct_times(before_test, time))
    n = index.n
    tw = cfg.window_train_size or max(n // 3, 1)
    vw = cfg.window_val_size or max(n // 6, 1)
    step = cfg.step_size or vw
    starts = range(0, n - tw - vw + 1, step)
    spans = [(0 if growing else s, s + tw, s + tw, s + tw + vw) for s in starts]
    if not spans:
        warnings.warn("walk-forward split produced no folds; check the window sizes")
    return _resolve(index, spans)


def rolling_folds(df: DataFrame, cfg: SplitConfig, time: str = "time") -> list[Fold]:
    """Fixed-length training windows moving forward up to the test cut."""
    return _walk_forward(df, cfg, time, growing=False)


def expanding_folds(df: DataFrame, cfg: SplitConfig, time: str = "time") -> list[Fold]:
    """Training windows growing from the start up to the test cut."""
    return _walk_forward(df, cfg, time, growing=True)


def purged_folds(
    df: DataFrame, n_folds: int = 3, gap: int = 0, min_train_size: int = 100, time: str = "time"
) -> list[Fold]:
    """Expanding folds with ``gap`` distinct times left out between train and validation.

    Folds with fewer than ``min_train_size`` training rows are dropped, without renumbering.
    """
    index = TimeIndex(distinct_times(df, time))
    n = index.n
    size = max(1, n // (n_folds + 1))
    spans = []
    for k in range(1, n_folds + 1):
        lo, hi = k * size + gap, min(k * size + gap + size, n)
        if lo >= n or hi <= lo:
            break
        spans.append((0, k * size, lo, hi))
    folds = _resolve(index, spans)
    if not folds:
        return []
    counts = {(r["fold"], r["role"]): r["n"] for r in fold_sizes(df, folds, time).collect()}
    return [
        f for f in folds
        if counts.get((f.fold, "train"), 0) >= min_train_size and counts.get((f.fold, "val"), 0) > 0
    ]


def fold_table(spark: SparkSession, folds: Sequence[Fold]) -> DataFrame:
    schema = "fold int, train_lo timestamp_ntz, train_hi timestamp_ntz, val_lo timestamp_ntz, val_hi timestamp_ntz"
    rows = [(f.fold, f.train_lo, f.train_hi, f.val_lo, f.val_hi) for f in folds]
    return spark.createDataFrame(rows, schema)


def assign_folds(df: DataFrame, folds: Sequence[Fold], time: str = "time") -> DataFrame:
    """One output row per (row, fold, role) membership; no shuffle and no join."""
    t = F.col(time)
    parts = [
        F.when(
            t.between(instant(lo), instant(hi)),
            F.struct(F.lit(f.fold).alias("fold"), F.lit(role).alias("role")),
        )
        for f in folds
        for role, lo, hi in (("train", f.train_lo, f.train_hi), ("val", f.val_lo, f.val_hi))
    ]
    if not parts:
        return df.select("*", F.lit(None).cast("int").alias("fold"), F.lit(None).cast("string").alias("role")).limit(0)
    return (
        df.withColumn("_m", F.explode(F.array_compact(F.array(*parts))))
        .select("*", "_m.fold", "_m.role")
        .drop("_m")
    )


def fold_sizes(df: DataFrame, folds: Sequence[Fold], time: str = "time") -> DataFrame:
    member = assign_folds(df.select(time), folds, time)
    return member.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"))


def index_folds(df: DataFrame, order: str, n_folds: int = 3) -> DataFrame:
    """Fallback folds by row position along a unique ``order`` column: (row, fold, role)."""
    n = df.count()
    size = max(1, n // (n_folds + 1))
    placed = with_running_total(df.withColumn("_one", F.lit(1)), [], order, {"_pos": "_one"})
    pos = F.col("_pos") - 1
    parts = []
    for k in range(1, n_folds + 1):
        hi = min((k + 1) * size, n)
        if hi <= k * size:
            continue
        role = F.when(pos < k * size, "train").when(pos < hi, "val")
        parts.append(F.when(role.isNotNull(), F.struct(F.lit(k).alias("fold"), role.alias("role"))))
    return (
        placed.withColumn("_m", F.explode(F.array_compact(F.array(*parts))))
        .select("*", "_m.fold", "_m.role")
        .drop("_m", "_one", "_pos")
    )


def spatial_holdout(df: DataFrame, region_col: str, holdout: Sequence[Any]) -> DataFrame:
    """Mark rows of the held-out regions; a NULL region is in-sample."""
    return df.withColumn("holdout", F.coalesce(F.col(region_col).isin(list(holdout)), F.lit(False)))


def spatial_holdout_by(df: DataFrame, region_col: str, holdout: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(in-sample, held-out) frames for a holdout given as a table."""
    return df.join(holdout, region_col, "left_anti"), df.join(holdout, region_col, "left_semi")


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(SPLIT).agg(F.count(F.lit(1)).alias("n"))


def split_bounds(df: DataFrame, time: str = "time") -> DataFrame:
    return df.groupBy(SPLIT).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def split_frames(df: DataFrame, cfg: SplitConfig, time: str = "time") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three frames (train, val, test)."""
    label = split_label(cfg, time)
    return tuple(df.filter(label == part) for part in ("train", "val", "test"))


def make_splits(df: DataFrame, cfg: SplitConfig, time: str = "time"):
    """A labelled frame (fixed) or a list of folds (rolling, expanding)."""
    if cfg.strategy == SplitStrategy.FIXED:
        return fixed_split(df, cfg, time)
    if cfg.strategy == SplitStrategy.ROLLING:
        return rolling_folds(df, cfg, time)
    if cfg.strategy == SplitStrategy.EXPANDING:
        return expanding_folds(df, cfg, time)
    raise ValueError(f"unknown split strategy {cfg.strategy!r}")
