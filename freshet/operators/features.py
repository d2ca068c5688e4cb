"""Lag, rolling, calendar and region features.

Everything ordered is computed in one window specification, so a feature table of any width
needs one exchange and one sort. Names follow ``lag_{k}_{band}`` and ``roll_{stat}{W}_{band}``;
a typed ``FeatureSpec`` travels along, so nothing has to parse names again.

Conventions: ``lag_0`` is the value at t; rolling frames hold the W rows strictly before t.
Distances are rows, not clock time.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from freshet.config import FeatureConfig, SampleMode, SeriesKeys
from freshet.functions.calendar import CYCLES, cyclical
from freshet.operators.ordering import OrderedView, ordered_view
from freshet.operators.quantiles import exact_percentiles, groups_fit_memory

_RN = "_rn"
ROLLING_STATS = ("mean", "std", "min", "max", "trend")
COORDS = ("y_idx", "x_idx")


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    kind: str  # lag | roll | coord | calendar
    band: str | None = None
    lag: int | None = None
    window: int | None = None
    stat: str | None = None


@dataclass(frozen=True)
class FeatureMeta:
    specs: tuple[FeatureSpec, ...]
    P: int
    bands: tuple[str, ...]
    sample_mode: str

    @property
    def names(self) -> list[str]:
        return [s.name for s in self.specs]


def present_bands(df: DataFrame, cfg: FeatureConfig) -> list[str]:
    bands = [b for b in cfg.bands if b in df.columns]
    if not bands:
        raise ValueError(f"none of the bands {list(cfg.bands)} among the columns {df.columns}")
    return bands


def lag_specs(bands: Iterable[str], P: int) -> list[FeatureSpec]:
    return [FeatureSpec(f"lag_{k}_{b}", "lag", b, lag=k) for k in range(P) for b in bands]


def rolling_specs(bands: Iterable[str], windows: Iterable[int], stats: Iterable[str]) -> list[FeatureSpec]:
    stats = list(stats)
    unknown = [s for s in stats if s not in ROLLING_STATS]
    if unknown:
        raise ValueError(f"unknown rolling statistics {unknown}; choose from {ROLLING_STATS}")
    bands = list(bands)
    return [
        FeatureSpec(f"roll_{s}{w}_{b}", "roll", b, window=w, stat=s)
        for w in windows for b in bands for s in stats
    ]


def feature_column(spec: FeatureSpec, w: WindowSpec) -> Column:
    """The windowed expression of a lag or rolling feature."""
    if spec.kind == "lag":
        return (F.lag(spec.band, spec.lag).over(w) if spec.lag else F.col(spec.band)).alias(spec.name)
    past = w.rowsBetween(-spec.window, -1)
    value = F.col(spec.band).cast("double")
    if spec.stat == "trend":
        # A slope does not change when positions are shifted, so slice-local numbers do.
        known = F.count(spec.band).over(past)
        return F.when(known >= 2, F.regr_slope(value, F.col(_RN)).over(past)).alias(spec.name)
    fn = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[spec.stat]
    return fn(value).over(past).alias(spec.name)


def reach_back(specs: Iterable[FeatureSpec]) -> int:
    """Rows before t that the widest feature looks at."""
    return max((max(s.lag or 0, s.window or 0) for s in specs), default=0)


def window_features(view: OrderedView, specs: Sequence[FeatureSpec], extra: Sequence[Column] = ()) -> DataFrame:
    """Append all windowed features (and ``extra`` windowed columns) in one projection."""
    w = view.window()
    df = view.df
    trend = any(s.stat == "trend" for s in specs)
    if trend:
        df = df.withColumn(_RN, F.row_number().over(w))
    out = df.select("*", *[feature_column(s, w) for s in specs], *extra)
    return out.drop(_RN) if trend else out


def pixel_specs(df: DataFrame, P: int, cfg: FeatureConfig, bands: Sequence[str]) -> list[FeatureSpec]:
    """All features of pixel mode, in output order."""
    specs = lag_specs(bands, P) if cfg.include_lags else []
    if cfg.include_rolling:
        specs += rolling_specs(bands, cfg.rolling_windows, cfg.rolling_stats)
    if cfg.include_spatial_coords:
        specs += [FeatureSpec(c, "coord") for c in COORDS if c in df.columns]
    if cfg.include_temporal:
        specs += [FeatureSpec(c, "calendar") for c in CYCLES]
    return specs


def build_features(
    df: DataFrame,
    P: int,
    cfg: FeatureConfig,
    sample_mode: SampleMode = SampleMode.PIXEL,
    keys: SeriesKeys = SeriesKeys(),
    region_col: str | None = None,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, FeatureMeta]:
    """Feature table of the chosen mode; rows with a missing feature are dropped.

    ``keep`` names input columns to carry through (raw bands for target construction), which
    saves joining them back later.
    """
    bands = present_bands(df, cfg)
    if sample_mode == SampleMode.REGION:
        return region_features(df, P, cfg, bands, keys, region_col)
    if sample_mode == SampleMode.PATCH:
        raise NotImplementedError("patch mode yields tensors; use freshet.operators.patches")
    specs = pixel_specs(df, P, cfg, bands)
    ordered = [s for s in specs if s.kind in ("lag", "roll")]
    view = ordered_view(df, [keys.entity], keys.order, before=reach_back(ordered))
    out = view.finish(window_features(view, ordered))
    out = add_calendar(out, keys.time) if cfg.include_temporal else out
    names = [s.name for s in specs]
    out = out.dropna(subset=names).select(keys.time, keys.entity, *keep, *names)
    return out, FeatureMeta(tuple(specs), P, tuple(bands), "pixel")


def add_calendar(df: DataFrame, time: str) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in cyclical(time).items()])


def region_aggregate(
    df: DataFrame, bands: Sequence[str], region_col: str, time: str = "time",
    stats: Sequence[str] = FeatureConfig().region_stats,
) -> DataFrame:
    """Spatial statistics per (region, time): ``{band}_{stat}`` columns.

    All but the median combine map-side. The median is exact: in the same aggregate while
    groups are of ordinary size, by rank selection otherwise.
    """
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "median": F.median}
    unknown = [s for s in stats if s not in fns]
    if unknown:
        raise ValueError(f"unknown region statistics {unknown}; choose from {tuple(fns)}")
    group = [region_col, time]
    df = df.dropna(subset=group)
    together = "median" not in stats or groups_fit_memory(df.select(*group), group)
    light = [s for s in stats if s != "median" or together]
    out = df.groupBy(*group).agg(*[fns[s](b).alias(f"{b}_{s}") for b in bands for s in light])
    if not together:
        for b in bands:
            out = out.join(exact_percentiles(df, group, b, {f"{b}_median": 0.5}), group)
    return out.select(*group, *[f"{b}_{s}" for b in bands for s in stats])


def region_features(
    df: DataFrame, P: int, cfg: FeatureConfig, bands: Sequence[str],
    keys: SeriesKeys, region_col: str | None,
) -> tuple[DataFrame, FeatureMeta]:
    """Lags and rolling statistics of the region aggregates."""
    if region_col is None:
        raise ValueError("region mode needs region_col")
    agg = region_aggregate(df, bands, region_col, keys.time, cfg.region_stats)
    cols = [f"{b}_{s}" for b in bands for s in cfg.region_stats]
    specs = lag_specs(cols, P) if cfg.include_lags else []
    if cfg.include_rolling:
        specs += rolling_specs(cols, cfg.rolling_windows, cfg.rolling_stats)
    view = ordered_view(agg, [region_col], [keys.time], before=reach_back(specs))
    names = [s.name for s in specs]
    out = view.finish(window_features(view, specs))
    out = out.dropna(subset=names).select(keys.time, region_col, *names)
    return out, FeatureMeta(tuple(specs), P, tuple(bands), "region")


def select_for_lookback(specs: Iterable[FeatureSpec], P: int) -> list[FeatureSpec]:
    """Features of a wider table that a lookback of ``P`` may use."""
    return [
        s for s in specs
        if not (s.kind == "lag" and s.lag >= P) and not (s.kind == "roll" and s.window > P)
    ]


def lag_only(specs: Iterable[FeatureSpec]) -> list[FeatureSpec]:
    """Lag features ordered by (lag, band): the layout of a sequence."""
    return sorted((s for s in specs if s.kind == "lag"), key=lambda s: (s.lag, s.band))


def sequence_column(specs: Iterable[FeatureSpec], oldest_first: bool = False) -> Column:
    """(P, bands) nested array of the lag features; newest step first unless asked."""
    lags = lag_only(specs)
    steps = sorted({s.lag for s in lags}, reverse=oldest_first)
    return F.array(*[F.array(*[F.col(s.name).cast("double") for s in lags if s.lag == k]) for k in steps])


def past_lags(
    df: DataFrame, value: str, P: int, keys: SeriesKeys = SeriesKeys()
) -> DataFrame:
    """Legacy lag table: ``lag_1 … lag_P`` of one value, excluding t."""
    view = ordered_view(df, [keys.entity], keys.order, before=P)
    w = view.window()
    return view.finish(view.df.select("*", *[F.lag(value, k).over(w).alias(f"lag_{k}") for k in range(1, P + 1)]))
