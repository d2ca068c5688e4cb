"""The earlier, lag-only workflow: unsaturated logistic target and one boosted model per (P, Q)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.config import SeriesKeys, SplitConfig
from freshet.functions.scores import sigmoid_target
from freshet.operators.metrics import scalar_metrics
from freshet.operators.models import fit_model, score
from freshet.operators.ordering import ordered_view
from freshet.operators.splits import split_frames
from freshet.runtime import in_parallel
from freshet.sources.sinks import save_table


def feature_target_table(
    series: DataFrame, p95: DataFrame, p_values: Sequence[int], q_values: Sequence[int],
    value: str = "precipitation", slope: float = 2.0, offset: float = 0.0, keys: SeriesKeys = SeriesKeys(),
) -> DataFrame:
    """Lags 1..max P, targets for every horizon; series without a p95 and incomplete rows go."""
    known = series.join(p95.dropna(subset=["p95"]).select(keys.entity, "p95"), keys.entity)
    horizons = sorted(set(q_values))
    view = ordered_view(known, [keys.entity], keys.order, max(p_values), max(horizons))
    w = view.window()
    out = view.df.select(
        "*",
        *[F.lag(value, k).over(w).alias(f"lag_{k}") for k in range(1, max(p_values) + 1)],
        *[sigmoid_target(F.lead(value, q).over(w), F.col("p95"), slope, offset).alias(f"target_q{q}") for q in horizons],
    )
    return view.finish(out).dropna()


def grid_search(
    base: DataFrame, p_values: Sequence[int], q_values: Sequence[int], split: SplitConfig,
    output_dir: str | None = None, time: str = "time", entity: str = "pixel_id", patience: int = 20, width: int = 4, **params,
) -> DataFrame:
    """Brier score of an early-stopped boosted model for each (P, Q); empty splits are skipped.

    Rounds end after ``patience`` without a lower validation error; ``width`` pairs are fitted at a time.
    """

    def run(p: int, q: int) -> tuple[str, float, int] | None:
        features, target = [f"lag_{k}" for k in range(1, p + 1)], f"target_q{q}"
        df = base.select(time, entity, *features, target).dropna()
        train, val, test = split_frames(df, split, time)
        if any(part.isEmpty() for part in (train, val, test)):
            return None
        fitting = train.withColumn("_held", F.lit(False)).unionByName(val.withColumn("_held", F.lit(True)))
        model = fit_model("GradientBoosting", fitting, features, target, validation_col="_held", patience=patience, **params)
        scored = score(model, test)
        brier = scalar_metrics(scored, target, "y_pred", names=("brier",)).first()["brier"]
        if output_dir:
            save_table(test, f"{output_dir}/exp_P{p}_Q{q}/test_set")
        return f"exp_P{p}_Q{q}", float(brier), int(model.model.getNumTrees)

    rows = [r for r in in_parallel([partial(run, p, q) for p, q in product(p_values, q_values)], width) if r]
    return base.sparkSession.createDataFrame(rows, "experiment string, brier_score double, best_iter int")
