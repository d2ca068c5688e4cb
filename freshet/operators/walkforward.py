"""Walk-forward evaluation over any number of folds, as joins.

Folds are runs of dense time positions. They are made by arithmetic in Spark, never as literals, and rows meet
them in an interval join: an interval of positions is cut into its dyadic segments (at most two per level), a
position lies in one segment per level, so membership is an equi-join on (level, segment) and needs no check
afterwards.

Linear models are fitted for all folds at once. Second moments are summed per position, then per dyadic segment;
a fold's training moments are the sum over the few segments of its interval, and every fold solves its own small
system in the task that holds it. Nothing of this passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.config import SplitConfig, SplitStrategy
from freshet.functions.scores import clip
from freshet.operators.climatology import instant
from freshet.operators.metrics import scalar_metrics
from freshet.operators.splits import distinct_times
from freshet.operators.ordering import with_running_total
from freshet.runtime import pin

#: Levels of dyadic segments: enough for 2^40 distinct times.
_LEVELS = 40


def time_positions(df: DataFrame, time: str = "time") -> DataFrame:
    """(time, pos): dense 0-based positions of the distinct times, pinned."""
    ranked = with_running_total(distinct_times(df, time).withColumn("_one", F.lit(1)), [], "time", {"_pos": "_one"})
    return pin(ranked.select("time", (F.col("_pos") - 1).cast("long").alias("pos")))


def walk_forward_intervals(spark: SparkSession, n: int, train: int, val: int, step: int, growing: bool) -> DataFrame:
    """(fold from 1, role, low, high): half-open runs of positions, for every fold that fits into n positions."""
    folds = max(0, (n - train - val) // step + 1) if n >= train + val else 0
    start = F.col("id") * step
    low = F.lit(0).cast("long") if growing else start
    pair = lambda role, a, b: F.struct(F.lit(role).alias("role"), a.alias("low"), b.alias("high"))
    both = F.array(pair("train", low, start + train), pair("val", start + train, start + train + val))
    return spark.range(folds).select((F.col("id") + 1).cast("int").alias("fold"), F.explode(both).alias("i")).select("fold", "i.*")


def configured_intervals(positions: DataFrame, cfg: SplitConfig) -> DataFrame:
    """The folds of a rolling or expanding split configuration over the times up to its test cut."""
    if cfg.strategy not in (SplitStrategy.ROLLING, SplitStrategy.EXPANDING):
        raise ValueError("walk-forward intervals need a rolling or expanding strategy")
    n = positions.filter(F.col("time") <= instant(cfg.val_end, cfg.end_of_day)).count()
    train = cfg.window_train_size or max(n // 3, 1)
    val = cfg.window_val_size or max(n // 6, 1)
    return walk_forward_intervals(positions.sparkSession, n, train, val, cfg.step_size or val, cfg.strategy == SplitStrategy.EXPANDING)


def _ceil_shift(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x + F.call_function("shiftleft", F.lit(1).cast("long"), level) - 1, level)


def _segments(intervals: DataFrame) -> DataFrame:
    """Intervals with one row per dyadic segment of theirs: columns level and segment."""
    def at(level: Column) -> Column:
        low, high = _ceil_shift(F.col("low"), level), F.call_function("shiftright", F.col("high"), level)
        here = low < high
        piece = lambda s: F.struct(level.alias("level"), s.alias("segment"))
        return F.array(F.when(here & (low % 2 == 1), piece(low)), F.when(here & (high % 2 == 1), piece(high - 1)))

    every = F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(_LEVELS)), at)))
    return intervals.select("*", F.explode(every).alias("_s")).select(*intervals.columns, "_s.level", "_s.segment")


def _with_levels(positions: DataFrame, levels: Sequence[int]) -> DataFrame:
    """Each position once per level in use, with its segment there."""
    level = F.explode(F.array(*[F.lit(k) for k in levels])).alias("level")
    return positions.select("*", level).withColumn("segment", F.expr("shiftright(pos, level)"))


def interval_join(positions: DataFrame, intervals: DataFrame) -> DataFrame:
    """Every (position row, interval) with low <= pos < high, each once."""
    pieces = pin(_segments(intervals))
    levels = [r[0] for r in pieces.select("level").distinct().orderBy("level").collect()]  # at most _LEVELS
    if not levels:
        return positions.crossJoin(intervals.limit(0)).drop("low", "high")
    return _with_levels(positions, levels).join(pieces.drop("low", "high"), ["level", "segment"]).drop("level", "segment")


def membership(df: DataFrame, positions: DataFrame, intervals: DataFrame, time: str = "time") -> DataFrame:
    """Rows of ``df`` with fold and role, once per membership. Intervals meet the distinct times, then times meet rows."""
    member = interval_join(positions, intervals).select(F.col("time").alias("_at"), "fold", "role")
    return df.join(member, df[time] == member["_at"]).drop("_at")


def fold_moment_sums(df: DataFrame, positions: DataFrame, intervals: DataFrame, features: Sequence[str], label: str, time: str = "time") -> tuple[DataFrame, list[float]]:
    """(fold, s): sums over the training rows of 1, of the shifted columns and of their products; and the shifts.

    Columns are shifted by their means over all rows, which keeps the products from cancelling. Rows with a NULL
    are skipped. ``s`` lists the upper triangle of the products of (1, features, label).
    """
    names = [*features, label]
    slim = df.select(F.col(time).alias("time"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]).dropna()
    row = slim.agg(*[F.avg(f"c{i}") for i in range(len(names))]).first()
    shift = [float(v or 0.0) for v in row]
    values = [F.lit(1.0), *[F.col(f"c{i}") - F.lit(v) for i, v in enumerate(shift)]]
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    sums = [f"s{k}" for k in range(len(pairs))]
    per_time = slim.groupBy("time").agg(*[F.sum(values[i] * values[j]).alias(s) for s, (i, j) in zip(sums, pairs)])
    pieces = pin(_segments(intervals.where("role = 'train'")))
    levels = [r[0] for r in pieces.select("level").distinct().orderBy("level").collect()]
    nodes = _with_levels(per_time.join(positions, "time").drop("time"), levels or [0])
    nodes = nodes.groupBy("level", "segment").agg(*[F.sum(s).alias(s) for s in sums])
    whole = pieces.join(nodes, ["level", "segment"]).groupBy("fold").agg(*[F.sum(s).alias(s) for s in sums])
    return whole.select("fold", F.array(*sums).alias("s")), shift


def ridge_by_fold(sums: DataFrame, shift: Sequence[float], alphas: Sequence[float]) -> DataFrame:
    """(fold, trial, weights, intercept): a ridge solution per fold and alpha; no alpha at all gives the mean of the label."""
    d = len(shift) - 1
    upper = np.triu_indices(d + 2)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for fold, s in zip(batch["fold"], batch["s"]):
                full = np.zeros((d + 2, d + 2))
                full[upper] = s
                n, means = full[0, 0], full[0, 1:] / full[0, 0]
                m = full[1:, 1:] - n * np.outer(means, means)
                m = np.triu(m) + np.triu(m, 1).T
                centre = means + shift
                if not alphas:
                    rows.append((fold, 0, [0.0] * d, float(centre[d])))
                for trial, alpha in enumerate(alphas):
                    w = np.linalg.lstsq(m[:d, :d] + alpha * np.eye(d), m[:d, d], rcond=None)[0]
                    rows.append((fold, trial, w.tolist(), float(centre[d] - centre[:d] @ w)))
            yield pd.DataFrame(rows, columns=["fold", "trial", "weights", "intercept"])

    return sums.mapInPandas(solve, "fold int, trial int, weights array<double>, intercept double")


def walk_forward(
    df: DataFrame, features: Sequence[str], label: str, cfg: SplitConfig, alphas: Sequence[float], names: Sequence[str] = ("rmse", "mae", "brier"), time: str = "time",
) -> DataFrame:
    """(fold, trial, n, metrics): every ridge strength fitted on every fold's training rows and scored on its validation rows."""
    positions = time_positions(df, time)
    intervals = pin(configured_intervals(positions, cfg))
    sums, shift = fold_moment_sums(df, positions, intervals, features, label, time)
    fitted = ridge_by_fold(sums, shift, alphas)
    rows = df.select(F.col(time).alias("time"), F.array(*[F.col(c).cast("double") for c in features]).alias("_x"), F.col(label).cast("double").alias("_y")).where(F.col("_y").isNotNull() & ~F.exists("_x", lambda v: v.isNull()))
    held = membership(rows, positions, intervals.where("role = 'val'"))
    dot = F.aggregate(F.zip_with("_x", "weights", lambda x, w: x * w), F.col("intercept"), lambda a, b: a + b)
    scored = held.join(fitted, "fold").select("fold", "trial", "_y", clip(dot).alias("_p"))
    return scalar_metrics(scored, "_y", "_p", names=("n", *names), by=("fold", "trial"))
