"""Alert threshold calibration and the anomaly report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.functions.calendar import season
from freshet.functions.scores import clip, intensity_band, is_event, residual
from freshet.operators.metrics import _beside, anomaly_metrics, judged, metric_columns, score_steps
from freshet.operators.ordering import bucket_of
from freshet.operators.quantiles import exact_percentiles
from freshet.runtime import keep, pin, temporary

METHODS = ("f1", "youden", "pr_auc")
DEFAULT_THRESHOLD = 0.5


def threshold_grid(resolution: int = 200) -> list[float]:
    return [float(t) for t in np.linspace(0.01, 0.99, resolution)]


def threshold_curve(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", resolution: int = 200,
    cutoff: float = 0.5, by: Sequence[str] = (),
) -> DataFrame:
    """Confusion counts at every grid threshold from one pass over the predictions.

    A prediction exceeds the first ``b`` thresholds and no more, so counting rows per ``b``
    (at most ``resolution + 1`` per group) holds all curves; the rest is a suffix sum.
    """
    cuts = F.array(*[F.lit(t) for t in threshold_grid(resolution)])
    rows = df.select(*by, is_event(y_true, cutoff).alias("e"), clip(y_pred).alias("p")).dropna(subset=["e", "p"])
    hist = rows.groupBy(*by, bucket_of(F.col("p"), cuts, resolution).alias("b")).agg(
        F.sum("e").alias("pos"), F.sum(1 - F.col("e")).alias("neg")
    )
    # One row per (group, b): the histogram as a map, read at every step of the ladder.
    packed = hist.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("b", F.struct("pos", "neg")))).alias("h")
    )
    full = packed.select(
        *by, F.lit(0).alias("_k"), F.explode(F.sequence(F.lit(0), F.lit(resolution))).alias("b"), "h"
    ).select(
        *by, "_k", "b",
        F.coalesce(F.try_element_at("h", F.col("b"))["pos"], F.lit(0)).cast("double").alias("pos"),
        F.coalesce(F.try_element_at("h", F.col("b"))["neg"], F.lit(0)).cast("double").alias("neg"),
    )
    whole = Window.partitionBy(*by, "_k")
    above = whole.orderBy(F.desc("b"))
    tp, fp = F.sum("pos").over(above), F.sum("neg").over(above)
    P, N = F.sum("pos").over(whole), F.sum("neg").over(whole)
    at = F.when(F.col("b") > 0, F.element_at(cuts, F.greatest(F.col("b"), F.lit(1))))
    return full.select(
        *by, "b", at.alias("threshold"),
        tp.alias("tp"), fp.alias("fp"), (P - tp).alias("fn"), (N - fp).alias("tn"),
    )


def calibrate(
    df: DataFrame, method: str = "f1", y_true: str = "y_true", y_pred: str = "y_pred",
    resolution: int = 200, cutoff: float = 0.5, by: Sequence[str] = (),
) -> DataFrame:
    """``(threshold, score)`` per group: the first best threshold, 0.5 if one class is missing."""
    if method not in METHODS:
        raise ValueError(f"unknown calibration method {method!r}; choose from {METHODS}")
    if method == "pr_auc":
        scored = _curve_scores(df, y_true, y_pred, cutoff, by)
    else:
        scored = _grid_scores(df, method, y_true, y_pred, resolution, cutoff, by)
    chosen = scored.select(
        *by,
        F.when(F.col("both"), F.col("threshold")).otherwise(DEFAULT_THRESHOLD).alias("threshold"),
        F.when(F.col("both"), F.col("score")).alias("score"),
    )
    best = [F.desc_nulls_last("score"), F.asc("threshold")]
    if not by:
        return chosen.orderBy(*best).limit(1)
    # Limited per task before the shuffle, so a group never gathers in one place.
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*best))
    return chosen.withColumn("_r", rank).filter("_r = 1").drop("_r")


def _grid_scores(df, method, y_true, y_pred, resolution, cutoff, by) -> DataFrame:
    c = threshold_curve(df, y_true, y_pred, resolution, cutoff, by).filter("b > 0")
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    if method == "f1":
        score = F.when(2 * tp + fp + fn > 0, 2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0.0))).otherwise(0.0)
    else:
        score = tp / F.greatest(tp + fn, F.lit(1.0)) + tn / F.greatest(tn + fp, F.lit(1.0)) - 1
    both = (tp + fn > 0) & (tn + fp > 0)
    return c.select(*by, "threshold", score.alias("score"), both.alias("both"))


def _curve_scores(df, y_true, y_pred, cutoff, by) -> DataFrame:
    """F1 at the distinct scores, counting ``>=``; the lowest score wins ties."""
    rows = df.select(*by, is_event(y_true, cutoff).alias("e"), clip(y_pred).alias("p")).dropna(subset=["e", "p"])
    sizes = rows.groupBy(*by).agg(
        F.sum("e").cast("double").alias("_pos"), F.sum(1 - F.col("e")).cast("double").alias("_neg")
    )
    steps = score_steps(df, y_true, y_pred, cutoff, by)
    if by:
        steps = steps.join(sizes, list(by))
    else:
        total = sizes.first()
        steps = steps.withColumns({"_pos": F.lit(total["_pos"] or 0.0), "_neg": F.lit(total["_neg"] or 0.0)})
    precision = F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    recall = F.col("cum_tp") / F.greatest(F.col("_pos"), F.lit(1.0))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-8))
    both = (F.col("_pos") > 0) & (F.col("_neg") > 0)
    return steps.select(*by, F.col("score").alias("threshold"), f1.alias("score"), both.alias("both"))


def best_threshold(df: DataFrame, method: str = "f1", **kw) -> float:
    row = calibrate(df, method, **kw).first()
    return float(row["threshold"]) if row else DEFAULT_THRESHOLD


def classify(df: DataFrame, threshold: float, y_pred: str = "y_pred", out: str = "alert") -> DataFrame:
    return df.withColumn(out, is_event(y_pred, threshold))


def confusion_matrix(
    df: DataFrame, threshold: float | Column, y_true: str = "y_true", y_pred: str = "y_pred", cutoff: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    names = ("tn", "fp", "fn", "tp")
    counts = judged(df, y_true, y_pred, threshold, cutoff).groupBy(*by).agg(*metric_columns(names))
    return counts.select(*by, *[F.col(n).cast("long").alias(n) for n in names])


def by_intensity(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """Errors per band of true intensity (and group); bands without rows do not appear."""
    p = clip(y_pred)
    err = F.col(y_true).cast("double") - p
    return df.groupBy(*by, intensity_band(y_true).alias("band")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(p).alias("mean_pred"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(err).alias("bias"),
    )


def by_season(
    df: DataFrame, threshold: float | Column, y_true: str = "y_true", y_pred: str = "y_pred",
    time: str = "time", cutoff: float = 0.5, by: Sequence[str] = (),
) -> DataFrame:
    rows = judged(df, y_true, y_pred, threshold, cutoff)
    return rows.groupBy(*by, season(time).alias("season")).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg("_e").alias("anomaly_rate"),
        *metric_columns(("precision", "recall", "f1")),
    )


def residual_profile(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, bias-corrected skewness and kurtosis, exact quantiles; one row (per group)."""
    spark = df.sparkSession
    with temporary(spark):
        # One small column: moments and quantiles read it from files instead of computing it again.
        r = pin(df.withColumn("_p", clip(y_pred)).select(*by, residual(y_true, "_p").alias("r")))
        n = F.count("r").cast("double")
        g1 = F.skewness("r") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
        g2 = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.kurtosis("r") + 6)
        flat = F.stddev_pop("r") == 0
        moments = r.groupBy(*by).agg(
            F.avg("r").alias("mean"),
            F.stddev_pop("r").alias("std"),
            F.when(n >= 3, F.when(flat, 0.0).otherwise(g1)).alias("skewness"),
            F.when(n >= 4, F.when(flat, 0.0).otherwise(g2)).alias("kurtosis"),
        )
        levels = {"q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95}
        return keep(_beside(moments, exact_percentiles(r, list(by), "r", levels), by))


@dataclass(frozen=True)
class AnomalyReport:
    """The parts of a report, each a small frame."""

    overall: DataFrame
    confusion: DataFrame
    intensity: DataFrame
    seasons: DataFrame | None
    residuals: DataFrame

    def to_dict(self) -> dict:
        out = {
            "overall": self.overall.first().asDict(),
            "confusion_matrix": self.confusion.first().asDict(),
            "by_intensity": {r["band"]: _rest(r, "band") for r in self.intensity.collect()},
            "residuals": self.residuals.first().asDict(),
        }
        if self.seasons is not None:
            out["by_season"] = {r["season"]: _rest(r, "season") for r in self.seasons.collect()}
        return out


def grouped_reports(
    df: DataFrame, by: Sequence[str], threshold: Column, y_true: str = "y_true", y_pred: str = "y_pred", time: str | None = "time", cutoff: float = 0.5,
) -> AnomalyReport:
    """The parts of all groups' reports at once: each part is one frame, its rows led by the group's columns.

    ``threshold`` is a column of ``df``, the same for all rows of a group. The number of jobs does not depend on
    the number of groups.
    """
    return AnomalyReport(
        overall=anomaly_metrics(df, threshold, y_true, y_pred, cutoff, by),
        confusion=confusion_matrix(df, threshold, y_true, y_pred, cutoff, by),
        intensity=by_intensity(df, y_true, y_pred, by),
        seasons=by_season(df, threshold, y_true, y_pred, time, cutoff, by) if time else None,
        residuals=residual_profile(df, y_true, y_pred, by),
    )


def report_documents(report: AnomalyReport, by: Sequence[str]) -> dict[tuple, dict]:
    """Grouped reports as one document per group; a few rows per group come to the driver."""
    out: dict[tuple, dict] = {}

    def rows(part: DataFrame):
        for r in part.collect():
            whole = r.asDict()
            yield out.setdefault(tuple(whole.pop(c) for c in by), {}), whole

    for name, part in (("overall", report.overall), ("confusion_matrix", report.confusion), ("residuals", report.residuals)):
        for document, row in rows(part):
            document[name] = row
    for name, part, key in (("by_intensity", report.intensity, "band"), ("by_season", report.seasons, "season")):
        if part is not None:
            for document in out.values():
                document[name] = {}
            for document, row in rows(part):
                document[name][row.pop(key)] = row
    return out


def _rest(row, key: str) -> dict:
    return {k: v for k, v in row.asDict().items() if k != key}


def anomaly_report(
    df: DataFrame, threshold: float, y_true: str = "y_true", y_pred: str = "y_pred",
    time: str | None = "time", cutoff: float = 0.5,
) -> AnomalyReport:
    return AnomalyReport(
        overall=anomaly_metrics(df, threshold, y_true, y_pred, cutoff),
        confusion=confusion_matrix(df, threshold, y_true, y_pred, cutoff),
        intensity=by_intensity(df, y_true, y_pred),
        seasons=by_season(df, threshold, y_true, y_pred, time, cutoff) if time else None,
        residuals=residual_profile(df, y_true, y_pred),
    )
