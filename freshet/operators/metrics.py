"""Regression, classification and ranking metrics of prediction tables.

Scalar metrics share one aggregate. Ranking metrics work on distinct scores: rows are counted
per score first, then running totals along the scores give ROC-AUC (ties count one half)
and step-wise average precision exactly. Both accept grouping columns, so the metrics of many
models or splits come from one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.scores import clip, is_event
from freshet.operators.ordering import with_running_total


def _ratio(num: Column, den: Column) -> Column:
    """num/den, 0 where undefined."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def judged(
    df: DataFrame, y_true: str, y_pred: str, threshold: float | Column = 0.5, cutoff: float | None = None
) -> DataFrame:
    """Add truth, clipped prediction, event and flag once, so that no metric recomputes them.

    ``threshold`` classifies predictions, ``cutoff`` (same by default) the truth.
    """
    rows = df.withColumns({"_y": F.col(y_true).cast("double"), "_p": clip(y_pred)})
    return rows.withColumns(
        {"_e": is_event("_y", threshold if cutoff is None else cutoff), "_h": is_event("_p", threshold)}
    )


def metric_columns(names: Sequence[str]) -> list[Column]:
    """Aggregate expressions for the named metrics over a ``judged`` frame."""
    y, p, event, flag = (F.col(c) for c in ("_y", "_p", "_e", "_h"))
    err = y - p

    def cell(e: int, h: int) -> Column:
        return F.count_if((event == e) & (flag == h)).cast("double")

    def r2() -> Column:
        sse, sst = F.sum(err * err), F.var_pop(y) * F.count(y)
        return F.when(sst > 0, 1 - sse / F.nullif(sst, F.lit(0.0))).when(sse == 0, 1.0).otherwise(0.0)

    def smape() -> Column:
        size = F.abs(y) + F.abs(p)
        part = F.when(size > 1e-12, F.abs(err) / F.greatest(size, F.lit(1e-12)))
        return F.coalesce(200.0 * F.avg(part), F.lit(0.0))

    def log_loss() -> Column:
        q = clip(p, 1e-7, 1.0 - 1e-7)
        return F.avg(-F.when(event == 1, F.ln(q)).otherwise(F.ln(1 - q)))

    tp, fp, tn, fn = (lambda e=e, h=h: cell(e, h) for e, h in ((1, 1), (0, 1), (0, 0), (1, 0)))
    makers = {
        "n": lambda: F.count(err),
        "brier": lambda: F.avg((event - p) * (event - p)),
        "rmse": lambda: F.sqrt(F.avg(err * err)),
        "mae": lambda: F.avg(F.abs(err)),
        "r2": r2,
        "smape": smape,
        "log_loss": log_loss,
        "tp": tp, "fp": fp, "tn": tn, "fn": fn,
        "accuracy": lambda: F.avg((event == flag).cast("double")),
        "precision": lambda: _ratio(tp(), tp() + fp()),
        "recall": lambda: _ratio(tp(), tp() + fn()),
        "f1": lambda: _ratio(2 * tp(), 2 * tp() + fp() + fn()),
        "fpr": lambda: fp() / F.greatest(fp() + tn(), F.lit(1.0)),
        "fnr": lambda: fn() / F.greatest(fn() + tp(), F.lit(1.0)),
    }
    return [makers[n]().alias(n) for n in names]


SCALARS = ("brier", "rmse", "mae", "r2", "smape", "accuracy", "precision", "recall", "f1", "log_loss", "fpr")
ANOMALY = ("tp", "fp", "tn", "fn", "precision", "recall", "f1", "fpr", "fnr")


def scalar_metrics(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", threshold: float = 0.5,
    names: Sequence[str] = SCALARS, by: Sequence[str] = (), cutoff: float | None = None,
) -> DataFrame:
    """Chosen metrics, one row (per group), in one aggregate."""
    return judged(df, y_true, y_pred, threshold, cutoff).groupBy(*by).agg(*metric_columns(names))


def score_steps(
    df: DataFrame, y_true: str, y_pred: str, cutoff: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """Per distinct score: pos, neg, and their running totals from the highest score down."""
    scored = df.select(*by, is_event(y_true, cutoff).alias("_e"), clip(y_pred).alias("score")).dropna(subset=["_e", "score"])
    counts = scored.groupBy(*by, "score").agg(
        F.sum("_e").cast("double").alias("pos"), F.sum(1 - F.col("_e")).cast("double").alias("neg")
    )
    counts = counts.withColumn("_down", -F.col("score"))
    return with_running_total(counts, list(by), "_down", {"cum_tp": "pos", "cum_fp": "neg"}).drop("_down")


def ranking_metrics(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", cutoff: float = 0.5,
    by: Sequence[str] = (), roc: str = "auc_roc", pr: str = "pr_auc",
) -> DataFrame:
    """Exact ROC-AUC and average precision; NULL when only one class is present."""
    steps = score_steps(df, y_true, y_pred, cutoff, by)
    P, N = F.sum("pos"), F.sum("neg")
    area = F.sum(F.col("neg") * (F.col("cum_tp") - F.col("pos") + F.col("pos") / 2))
    step = F.sum(F.col("pos") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp")))
    both = (P > 0) & (N > 0)
    return steps.groupBy(*by).agg(
        F.when(both, area / F.nullif(P * N, F.lit(0.0))).alias(roc),
        F.when(both, step / F.nullif(P, F.lit(0.0))).alias(pr),
    )


def _beside(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Put two per-group result rows side by side (single rows when ``by`` is empty)."""
    if by:
        return left.join(right, list(by), "left")
    names = [*left.columns, *right.columns]
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.max(n).alias(n) for n in names])


def evaluate(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", threshold: float = 0.5, by: Sequence[str] = ()
) -> DataFrame:
    """The full metric set, one row (per group)."""
    return _beside(
        scalar_metrics(df, y_true, y_pred, threshold, by=by),
        ranking_metrics(df, y_true, y_pred, threshold, by),
        by,
    )


def anomaly_metrics(
    df: DataFrame, threshold: float | Column, y_true: str = "y_true", y_pred: str = "y_pred",
    cutoff: float = 0.5, by: Sequence[str] = (),
) -> DataFrame:
    """Confusion counts, rates and ranking metrics at a decision threshold.

    ``threshold`` may be a column, for groups with thresholds of their own.
    """
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    rows = judged(df.withColumn("_t", t), y_true, y_pred, F.col("_t"), cutoff)
    scalars = rows.groupBy(*by).agg(F.max("_t").alias("threshold"), *metric_columns(ANOMALY))
    return _beside(scalars, ranking_metrics(df, y_true, y_pred, cutoff, by, roc="roc_auc"), by)
