"""Future values and extremeness targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.config import FeatureConfig, FuzzyConfig, SeriesKeys, TARGET_BAND
from freshet.functions.scores import vp
from freshet.operators.features import (
    FeatureMeta, add_calendar, pixel_specs, present_bands, reach_back, window_features,
)
from freshet.operators.ordering import ordered_view


def _score_futures(df: DataFrame, q_values: Sequence[int], fuzzy: FuzzyConfig) -> DataFrame:
    scored = {
        f"target_q{q}": vp(f"_future_{q}", "p90", "p95", "p100", fuzzy.mode, fuzzy.eps) for q in q_values
    }
    return df.withColumns(scored).drop(*[f"_future_{q}" for q in q_values])


def add_targets(
    df: DataFrame,
    q_values: Sequence[int],
    thresholds: DataFrame,
    fuzzy: FuzzyConfig = FuzzyConfig(),
    band: str = TARGET_BAND,
    keys: SeriesKeys = SeriesKeys(),
) -> DataFrame:
    """Add ``target_q{Q}`` for every horizon; the last Q rows of a series get NULL.

    All leads share one window; thresholds are joined on the window's own partitioning.
    """
    view = ordered_view(df, [keys.entity], keys.order, after=max(q_values))
    w = view.window()
    led = view.df.select("*", *[F.lead(band, q).over(w).alias(f"_future_{q}") for q in q_values])
    return _score_futures(view.finish(view.join_groups(led, thresholds)), q_values, fuzzy)


def features_and_targets(
    df: DataFrame,
    P: int,
    cfg: FeatureConfig,
    q_values: Sequence[int],
    thresholds: DataFrame,
    fuzzy: FuzzyConfig = FuzzyConfig(),
    band: str = TARGET_BAND,
    keys: SeriesKeys = SeriesKeys(),
) -> tuple[DataFrame, FeatureMeta]:
    """The base table: features, raw bands and all targets from a single window pass."""
    bands = present_bands(df, cfg)
    specs = pixel_specs(df, P, cfg, bands)
    ordered = [s for s in specs if s.kind in ("lag", "roll")]
    view = ordered_view(df, [keys.entity], keys.order, reach_back(ordered), max(q_values))
    w = view.window()
    leads = [F.lead(band, q).over(w).alias(f"_future_{q}") for q in q_values]
    wide = window_features(view, ordered, leads)
    names = [s.name for s in specs]
    if cfg.include_temporal:
        wide = add_calendar(wide, keys.time)
    wide = view.finish(view.join_groups(wide, thresholds)).dropna(subset=names)
    out = _score_futures(wide, q_values, fuzzy)
    targets = [f"target_q{q}" for q in q_values]
    carried = [b for b in bands if b not in names]
    out = out.select(keys.time, keys.entity, *keys.tie, *carried, *names, *targets)
    return out, FeatureMeta(tuple(specs), P, tuple(bands), "pixel")


def target_summary(df: DataFrame, q_values: Sequence[int]) -> DataFrame:
    """Per horizon: usable targets, targets above one half, mean. One pass, one row each."""
    aggs = []
    for q in q_values:
        y = F.col(f"target_q{q}")
        aggs.append(
            F.struct(
                F.lit(q).alias("Q"),
                F.count(y).alias("n_valid"),
                F.count_if(y > 0.5).alias("n_above_05"),
                F.avg(y).alias("vp_mean"),
            ).alias(f"s{q}")
        )
    return df.agg(*aggs).select(F.explode(F.array(*[f"s{q}" for q in q_values])).alias("s")).select("s.*")
