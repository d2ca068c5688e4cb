"""Named queries over the given tables, each with an independent SQL statement of its result.

Both sides round doubles to six digits, since sums may differ in their last bits.
"""

from __future__ import annotations

import functools
import math
import random
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.config import FeatureConfig, FuzzyConfig, PipelineConfig, SampleMode, SplitConfig, SplitStrategy, TargetMode
from freshet.functions import scores
from freshet.functions.calendar import cyclical
from freshet.functions.losses import loss
from freshet.functions.naming import band_name, band_time, file_time
from freshet.operators import alerts, climatology as clim, features as feat, metrics, quality, scaling, splits, targets
from freshet.operators.extratree import draw as extra_draw
from freshet.operators.models import fit_model, score, solve
from freshet.operators.neighbour_index import build_index, indexed_predictions
from freshet.operators.neighbours import knn_predict
from freshet.operators.patches import build_patches, number_patches
from freshet.operators.sampling import hash_sample
from freshet.operators.search import SEARCH_SPACES, draw, fold_moments, score_trials
from freshet.operators.walkforward import walk_forward
from freshet.plans import series as src
from freshet.runtime import keep, pin, temporary
from freshet.sources import tiles
from freshet.sources.sinks import append_summary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _owning(fn: Query) -> Query:
    """The query with an owner for its intermediate tables: where it wrote any, its result is written and they are deleted."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with temporary(spark) as made:
            out = fn(spark, sf_dir)
            return keep(out) if made else out

    return run


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = _owning(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles; adding zero turns a negative zero into a plain one."""
    return df.select(
        *[
            (F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def rnd(expr: str, alias: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {alias}"


def rnds(*names: str) -> str:
    return ", ".join(rnd(n, n) for n in names)


# --- SQL building blocks ------------------------------------------------------------------

E = """e AS (
  SELECT user_id AS pixel_id, ts AS time, event_id, CAST(user_id // 16 AS INT) AS y_idx,
         CAST(user_id % 16 AS INT) AS x_idx, value AS tp,
         TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE) AS t2m
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)"""
L = """l AS (
  SELECT l_suppkey AS pixel_id, l_shipdate AS time, sum(l_quantity) AS tp, avg(l_discount) AS t2m
  FROM lineitem WHERE l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL GROUP BY 1, 2)"""
R = """r AS (
  SELECT n_regionkey AS region_id, time, avg(tp) AS tp_mean, stddev_samp(tp) AS tp_std, min(tp) AS tp_min,
         max(tp) AS tp_max, median(tp) AS tp_median, avg(t2m) AS t2m_mean, stddev_samp(t2m) AS t2m_std,
         min(t2m) AS t2m_min, max(t2m) AS t2m_max, median(t2m) AS t2m_median
  FROM l JOIN supplier ON s_suppkey = pixel_id JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2)"""
KE = "PARTITION BY pixel_id ORDER BY time, event_id"
KL = "PARTITION BY pixel_id ORDER BY time"


def thr(src_name: str, name: str = "thr", where: str = "TRUE") -> str:
    return (
        f"{name} AS (SELECT pixel_id, quantile_cont(tp, 0.9) AS p90, quantile_cont(tp, 0.95) AS p95, "
        f"max(tp) AS p100 FROM {src_name} WHERE {where} GROUP BY 1)"
    )


def sql_piecewise(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NULL OR p90 IS NULL THEN NULL WHEN {x} <= p90 THEN 0.0 "
        f"WHEN {x} < p95 THEN 0.5 * ({x} - p90) / greatest(p95 - p90, 1e-12) "
        f"WHEN {x} < p100 THEN 0.5 + 0.5 * ({x} - p95) / greatest(p100 - p95, 1e-12) ELSE 1.0 END"
    )


def sql_sigmoid(x: str, eps: float = 0.02) -> str:
    k = repr(math.log(1 / eps - 1))
    z = f"least(greatest({k} / greatest(p95 - p90, 1e-12) * ({x} - p95), -50.0), 50.0)"
    return (
        f"CASE WHEN {x} IS NULL OR p90 IS NULL THEN NULL WHEN {x} <= p90 THEN 0.0 WHEN {x} >= p100 THEN 1.0 "
        f"ELSE 1.0 / (1.0 + exp(-({z}))) END"
    )


def sql_tanh(x: str, eps: float = 0.02) -> str:
    a = repr(math.atanh(1 - 2 * eps))
    return (
        f"CASE WHEN {x} IS NULL OR p90 IS NULL THEN NULL WHEN {x} <= p90 THEN 0.0 WHEN {x} >= p100 THEN 1.0 "
        f"ELSE 0.5 + 0.5 * tanh({a} * ({x} - p95) / greatest(p95 - p90, 1e-12)) END"
    )


def sql_roll(stat: str, w: int, band: str, key: str) -> str:
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}[stat]
    return f"{fn}({band}) OVER ({key} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"


def sql_lag(k: int, band: str, key: str) -> str:
    return f"lag({band}, {k}) OVER ({key})" if k else band


def sql_features(specs: Sequence[feat.FeatureSpec], key: str) -> dict[str, str]:
    return {s.name: sql_lag(s.lag, s.band, key) if s.kind == "lag" else sql_roll(s.stat, s.window, s.band, key) for s in specs}


def sql_cycles() -> dict[str, str]:
    two_pi = repr(2 * math.pi)
    angle = {
        "hour": f"{two_pi} * hour(time) / 24.0",
        "month": f"{two_pi} * (month(time) - 1) / 12.0",
        "doy": f"{two_pi} * dayofyear(time) / 365.25",
    }
    return {f"{n}_{f}": f"{f}({a})" for n, a in angle.items() for f in ("sin", "cos")}


def sql_table(ctes: Sequence[str], source: str, ids: str, named: dict[str, str], drop_nulls: bool = True) -> str:
    inner = ", ".join(f"{expr} AS {name}" for name, expr in named.items())
    where = " AND ".join(f"{n} IS NOT NULL" for n in named) if drop_nulls else "TRUE"
    return (
        f"WITH {', '.join(ctes)}, w AS (SELECT {ids}, {inner} FROM {source}) "
        f"SELECT {ids}, {rnds(*named)} FROM w WHERE {where}"
    )


EVENT_SPLIT_SQL = "CASE WHEN time <= TIMESTAMP '2024-01-20' THEN 'train' WHEN time <= TIMESTAMP '2024-01-25' THEN 'val' ELSE 'test' END"
DAY_SPLIT_SQL = "CASE WHEN time <= TIMESTAMP '1999-12-31' THEN 'train' WHEN time <= TIMESTAMP '2000-12-31' THEN 'val' ELSE 'test' END"

# --- Features -----------------------------------------------------------------------------

BANDS = ("tp", "t2m")
E_IDS = "pixel_id, time, event_id"


def _rolling(spark, sf, stats, windows=(3, 6), daily=False):
    cfg = FeatureConfig(
        bands=BANDS, rolling_windows=windows, rolling_stats=stats, include_lags=False,
        include_spatial_coords=False, include_temporal=False,
    )
    df = src.daily_series(spark, sf) if daily else src.event_series(spark, sf)
    keys = src.DAY_KEYS if daily else src.EVENT_KEYS
    return tidy(feat.build_features(df, 1, cfg, keys=keys, keep=() if daily else ("event_id",))[0])


def _rolling_sql(stats, windows=(3, 6)):
    specs = feat.rolling_specs(BANDS, windows, stats)
    return sql_table([E], "e", E_IDS, sql_features(specs, KE))


@query("lag_features", sql_table([E], "e", E_IDS, sql_features(feat.lag_specs(BANDS, 3), KE)))
def lag_features(spark, sf):
    cfg = FeatureConfig(bands=BANDS, include_rolling=False, include_spatial_coords=False, include_temporal=False)
    return tidy(feat.build_features(src.event_series(spark, sf), 3, cfg, keys=src.EVENT_KEYS, keep=("event_id",))[0])


@query("rolling_mean", _rolling_sql(("mean",)))
def rolling_mean(spark, sf):
    return _rolling(spark, sf, ("mean",))


@query("rolling_std", _rolling_sql(("std",)))
def rolling_std(spark, sf):
    return _rolling(spark, sf, ("std",))


@query("rolling_minmax", _rolling_sql(("min", "max")))
def rolling_minmax(spark, sf):
    return _rolling(spark, sf, ("min", "max"))


def _trend_sql(w: int, band: str) -> str:
    frame = f"({KL} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({band}) OVER {frame} >= 2 THEN regr_slope({band}, rn) OVER {frame} END"


@query(
    "rolling_trend",
    sql_table(
        [L, f"n AS (SELECT *, row_number() OVER ({KL}) AS rn FROM l)"], "n", "pixel_id, time",
        {f"roll_trend{w}_{b}": _trend_sql(w, b) for w in (3, 6) for b in BANDS},
    ),
)
def rolling_trend(spark, sf):
    return _rolling(spark, sf, ("trend",), daily=True)


@query("cyclical_time", sql_table([E], "e", "time, event_id", sql_cycles()))
def cyclical_time(spark, sf):
    e = src.event_series(spark, sf)
    return tidy(e.select("time", "event_id", *[c.alias(n) for n, c in cyclical("time").items()]))


FULL_CFG = FeatureConfig(bands=BANDS)
FULL_ORDERED = [*feat.lag_specs(BANDS, 6), *feat.rolling_specs(BANDS, (3, 6), ("mean", "std"))]


@query(
    "pixel_feature_table",
    sql_table([E], "e", E_IDS, {**sql_features(FULL_ORDERED, KE), **sql_cycles()}).replace(
        f"SELECT {E_IDS}, round", f"SELECT {E_IDS}, y_idx, x_idx, round"
    ).replace(f"w AS (SELECT {E_IDS},", f"w AS (SELECT {E_IDS}, y_idx, x_idx,"),
)
def pixel_feature_table(spark, sf):
    return tidy(feat.build_features(src.event_series(spark, sf), 6, FULL_CFG, keys=src.EVENT_KEYS, keep=("event_id",))[0])


REGION_STATS = FeatureConfig().region_stats
REGION_COLS = tuple(f"{b}_{s}" for b in BANDS for s in REGION_STATS)


@query("region_aggregate", f"WITH {L}, {R} SELECT region_id, time, {rnds(*REGION_COLS)} FROM r")
def region_aggregate(spark, sf):
    d = src.with_region(spark, sf, src.daily_series(spark, sf))
    return tidy(feat.region_aggregate(d, BANDS, "region_id"))


@query(
    "region_feature_table",
    sql_table(
        [L, R], "r", "region_id, time",
        sql_features(
            [*feat.lag_specs(REGION_COLS, 3), *feat.rolling_specs(REGION_COLS, (3,), ("mean", "std"))],
            "PARTITION BY region_id ORDER BY time",
        ),
    ),
)
def region_feature_table(spark, sf):
    d = src.with_region(spark, sf, src.daily_series(spark, sf))
    cfg = FeatureConfig(bands=BANDS, rolling_windows=(3,))
    return tidy(feat.build_features(d, 3, cfg, SampleMode.REGION, src.DAY_KEYS, "region_id")[0])


_KR = "PARTITION BY region_id ORDER BY time"
_REGION_SPECS = [*feat.lag_specs(REGION_COLS, 3), *feat.rolling_specs(REGION_COLS, (3,), ("mean", "std"))]
_REGION_WHOLE = " AND ".join(f"{s.name} IS NOT NULL" for s in _REGION_SPECS)


@query(
    "region_base_table",
    f"WITH {L}, {R}, thr AS (SELECT region_id, quantile_cont(tp_mean, 0.9) AS p90, quantile_cont(tp_mean, 0.95) AS p95, max(tp_mean) AS p100 FROM r GROUP BY 1), "
    f"w AS (SELECT region_id, time, {', '.join(f'{e} AS {n}' for n, e in sql_features(_REGION_SPECS, _KR).items())}, "
    f"lead(tp_mean) OVER ({_KR}) AS f1, lead(tp_mean, 3) OVER ({_KR}) AS f3 FROM r), "
    f"t AS (SELECT region_id, time, {', '.join(s.name for s in _REGION_SPECS)}, {sql_sigmoid('f1')} AS target_q1, {sql_sigmoid('f3')} AS target_q3 "
    f"FROM w LEFT JOIN thr USING (region_id) WHERE {_REGION_WHOLE}) "
    f"SELECT region_id, time, {rnds('lag_0_tp_mean', 'lag_2_tp_max', 'target_q1', 'target_q3')} FROM t",
)
def region_base_table(spark, sf):
    from freshet.plans.experiment import base_table, region_run

    d = src.with_region(spark, sf, src.daily_series(spark, sf))
    cfg = PipelineConfig(
        p_values=(3,), q_values=(1, 3), sample_mode=SampleMode.REGION,
        feature_config=FeatureConfig(bands=BANDS, rolling_windows=(3,), rolling_stats=("mean", "std")),
    )
    run = region_run(d, cfg, "region_id", src.DAY_KEYS)
    series = pin(run.series)
    base, _ = base_table(series, clim.climatology(series, run.band, "region_id"), run.cfg, run.keys, run.band)
    return tidy(base.select("region_id", "time", "lag_0_tp_mean", "lag_2_tp_max", "target_q1", "target_q3"))


@query(
    "feature_select_for_p",
    sql_table([E], "e", E_IDS, sql_features([*feat.lag_specs(BANDS, 3), *feat.rolling_specs(BANDS, (3,), ("mean", "std"))], KE)
              | {f"_x{k}": sql_lag(k, "tp", KE) for k in (5,)}).replace(f", {rnd('_x5', '_x5')}", ""),
)
def feature_select_for_p(spark, sf):
    """A table built for P = 6, narrowed to what P = 3 may use."""
    cfg = FeatureConfig(bands=BANDS, include_spatial_coords=False, include_temporal=False)
    df, meta = feat.build_features(src.event_series(spark, sf), 6, cfg, keys=src.EVENT_KEYS, keep=("event_id",))
    keep = [s.name for s in feat.select_for_lookback(meta.specs, 3)]
    return tidy(df.select("pixel_id", "time", "event_id", *keep))


def _num_text(expr: str) -> str:
    return f"CAST(CAST(round({expr} * 100) AS BIGINT) AS VARCHAR)"


@query(
    "sequence_features",
    f"WITH {E}, w AS (SELECT {E_IDS}, "
    + ", ".join(f"{sql_lag(k, b, KE)} AS {b}{k}" for k in range(3) for b in BANDS)
    + f" FROM e) SELECT {E_IDS}, "
    + " || ';' || ".join(f"{_num_text(f't2m{k}')} || ',' || {_num_text(f'tp{k}')}" for k in range(3))
    + " AS sequence FROM w WHERE "
    + " AND ".join(f"{b}{k} IS NOT NULL" for k in range(3) for b in BANDS),
)
def sequence_features(spark, sf):
    """(P, bands) arrays, newest step first, bands by name; written as hundredths in text."""
    cfg = FeatureConfig(bands=BANDS, include_rolling=False, include_spatial_coords=False, include_temporal=False)
    df, meta = feat.build_features(src.event_series(spark, sf), 3, cfg, keys=src.EVENT_KEYS, keep=("event_id",))
    text = F.transform(
        feat.sequence_column(meta.specs),
        lambda step: F.array_join(F.transform(step, lambda v: F.round(v * 100).cast("long").cast("string")), ","),
    )
    return df.select("pixel_id", "time", "event_id", F.array_join(text, ";").alias("sequence"))


# --- Climatology and targets --------------------------------------------------------------


@query(
    "climatology_percentiles",
    f"WITH {E}, {thr('e')} SELECT pixel_id, {rnds('p90', 'p95', 'p100')} FROM thr",
)
def climatology_percentiles(spark, sf):
    return tidy(clim.climatology(src.event_series(spark, sf), "tp"))


@query(
    "climatology_train_cut",
    f"WITH {L} SELECT pixel_id, {rnd('quantile_cont(tp, 0.95)', 'p95')} FROM l WHERE time <= TIMESTAMP '1999-12-31' GROUP BY 1",
)
def climatology_train_cut(spark, sf):
    return tidy(clim.train_climatology(src.daily_series(spark, sf), "tp", "1999-12-31"))


@query(
    "threshold_align",
    f"WITH {L}, {thr('l')} SELECT l.pixel_id, time, {rnds('tp', 'p90', 'p95', 'p100')} FROM l LEFT JOIN thr USING (pixel_id)",
)
def threshold_align(spark, sf):
    d = src.daily_series(spark, sf)
    return tidy(clim.align_thresholds(d, clim.climatology(d, "tp")).select("pixel_id", "time", "tp", "p90", "p95", "p100"))


TRAIN_P95 = "p AS (SELECT pixel_id, quantile_cont(tp, 0.95) AS p95 FROM l WHERE time <= TIMESTAMP '1999-12-31' GROUP BY 1)"


@query("train_p95_lookup", f"WITH {L}, {TRAIN_P95} SELECT l.pixel_id, time, {rnds('tp', 'p95')} FROM l LEFT JOIN p USING (pixel_id)")
def train_p95_lookup(spark, sf):
    d = src.daily_series(spark, sf)
    out = clim.p95_lookup(d, "tp", "train", train=F.col("time") <= clim.instant("1999-12-31"))
    return tidy(out.select("pixel_id", "time", "tp", "p95"))


RICH = "s_acctbal > 0"


@query(
    "external_p95_lookup",
    f"WITH {L}, p AS (SELECT pixel_id, quantile_cont(tp, 0.95) AS p95 FROM l JOIN supplier ON s_suppkey = pixel_id WHERE {RICH} GROUP BY 1) "
    f"SELECT l.pixel_id, time, {rnds('tp', 'p95')} FROM l LEFT JOIN p USING (pixel_id)",
)
def external_p95_lookup(spark, sf):
    d = src.daily_series(spark, sf)
    return tidy(clim.p95_lookup(d, external=_rich_p95(spark, sf, d)).select("pixel_id", "time", "tp", "p95"))


def _rich_p95(spark, sf, d):
    """A p95 table that lacks some series."""
    rich = src.table(spark, sf, "supplier").filter(RICH).select(F.col("s_suppkey").alias("pixel_id"))
    return clim.climatology(d.join(rich, "pixel_id", "left_semi"), "tp", levels={"p95": 0.95})


@query(
    "p95_inner",
    f"WITH {L}, p AS (SELECT pixel_id, quantile_cont(tp, 0.95) AS p95 FROM l JOIN supplier ON s_suppkey = pixel_id WHERE {RICH} GROUP BY 1) "
    f"SELECT l.pixel_id, time, {rnds('tp', 'p95')} FROM l JOIN p USING (pixel_id)",
)
def p95_inner(spark, sf):
    d = src.daily_series(spark, sf)
    return tidy(d.join(_rich_p95(spark, sf, d), "pixel_id").select("pixel_id", "time", "tp", "p95"))


def _vp_now(spark, sf, mode):
    e = src.event_series(spark, sf)
    aligned = clim.align_thresholds(e, clim.climatology(e, "tp"))
    return tidy(aligned.select("pixel_id", "time", "event_id", scores.vp("tp", "p90", "p95", "p100", mode).alias("vp")))


def _vp_sql(expr):
    return f"WITH {E}, {thr('e')} SELECT pixel_id, time, event_id, {rnd(expr, 'vp')} FROM e LEFT JOIN thr USING (pixel_id)"


@query("vp_piecewise", _vp_sql(sql_piecewise("tp")))
def vp_piecewise(spark, sf):
    return _vp_now(spark, sf, TargetMode.PIECEWISE)


@query("vp_sigmoid", _vp_sql(sql_sigmoid("tp")))
def vp_sigmoid(spark, sf):
    return _vp_now(spark, sf, TargetMode.SIGMOID)


@query("vp_tanh", _vp_sql(sql_tanh("tp")))
def vp_tanh(spark, sf):
    return _vp_now(spark, sf, TargetMode.TANH)


@query("legacy_sigmoid_target", _vp_sql("1.0 / (1.0 + exp(-0.05 * (tp - (p95 + 1.0))))"))
def legacy_sigmoid_target(spark, sf):
    e = src.event_series(spark, sf)
    aligned = clim.align_thresholds(e, clim.climatology(e, "tp"))
    return tidy(aligned.select("pixel_id", "time", "event_id", scores.sigmoid_target("tp", "p95", 0.05, 1.0).alias("vp")))


Q_VALUES = (1, 3)


def _event_targets(spark, sf, q_values=Q_VALUES, fuzzy=FuzzyConfig()):
    e = src.event_series(spark, sf)
    return targets.add_targets(e, q_values, clim.climatology(e, "tp"), fuzzy, keys=src.EVENT_KEYS)


TARGETS_SQL = (
    f"WITH {E}, {thr('e')}, f AS (SELECT *, "
    + ", ".join(f"lead(tp, {q}) OVER ({KE}) AS f{q}" for q in Q_VALUES)
    + " FROM e), t AS (SELECT f.*, p90, p95, p100, "
    + ", ".join(f"{sql_sigmoid(f'f{q}')} AS target_q{q}" for q in Q_VALUES)
    + " FROM f LEFT JOIN thr USING (pixel_id))"
)


@query("targets_all_horizons", f"{TARGETS_SQL} SELECT {E_IDS}, {rnds('target_q1', 'target_q3')} FROM t")
def targets_all_horizons(spark, sf):
    return tidy(_event_targets(spark, sf).select("pixel_id", "time", "event_id", "target_q1", "target_q3"))


@query(
    "target_summary",
    f"{TARGETS_SQL} "
    + " UNION ALL ".join(
        f"SELECT CAST({q} AS INT) AS \"Q\", count(target_q{q}) AS n_valid, count(*) FILTER (WHERE target_q{q} > 0.5) AS n_above_05, "
        f"{rnd(f'avg(target_q{q})', 'vp_mean')} FROM t"
        for q in Q_VALUES
    ),
)
def target_summary(spark, sf):
    return tidy(targets.target_summary(_event_targets(spark, sf), Q_VALUES))


LEGACY = {f"lag_{k}": sql_lag(k, "tp", KL) for k in range(1, 4)} | {
    f"target_q{q}": f"1.0 / (1.0 + exp(-2.0 * (lead(tp, {q}) OVER ({KL}) - (p95 + 0.0))))" for q in Q_VALUES
}


@query(
    "legacy_feature_target",
    sql_table(
        [L, f"p AS (SELECT pixel_id, quantile_cont(tp, 0.95) AS p95 FROM l JOIN supplier ON s_suppkey = pixel_id WHERE {RICH} GROUP BY 1)",
         "j AS (SELECT l.*, p95 FROM l JOIN p USING (pixel_id))"],
        "j", "pixel_id, time, tp, p95", LEGACY,
    ).replace("SELECT pixel_id, time, tp, p95, round", f"SELECT pixel_id, time, {rnds('tp', 'p95')}, round"),
)
def legacy_feature_target(spark, sf):
    from freshet.plans.legacy import feature_target_table

    d = src.daily_series(spark, sf).drop("t2m")
    return tidy(feature_target_table(d, _rich_p95(spark, sf, d), (3,), Q_VALUES, value="tp"))


@query(
    "param_grid_cross",
    f"{TARGETS_SQL}, n AS (SELECT t.*, row_number() OVER ({KE}) AS rn FROM t) "
    + " UNION ALL ".join(
        f"SELECT CAST({p} AS INT) AS \"P\", CAST({q} AS INT) AS \"Q\", count(*) AS n_rows, {rnd(f'avg(target_q{q})', 'vp_mean')} "
        f"FROM n WHERE rn >= {p} AND target_q{q} IS NOT NULL"
        for p in (3, 6) for q in Q_VALUES
    ),
)
def param_grid_cross(spark, sf):
    """Usable rows and mean target of every (lookback, horizon), from one pass over the base table."""
    from freshet.plans.experiment import grid_coverage

    e = src.event_series(spark, sf)
    cfg = FeatureConfig(bands=("tp",), include_rolling=False, include_spatial_coords=False, include_temporal=False)
    return tidy(grid_coverage(e, cfg, (3, 6), Q_VALUES, clim.climatology(e, "tp"), src.EVENT_KEYS))


# --- Splits -------------------------------------------------------------------------------


@query("fixed_split", f"WITH {E} SELECT {E_IDS}, {EVENT_SPLIT_SQL} AS split FROM e")
def fixed_split(spark, sf):
    return splits.fixed_split(src.event_series(spark, sf).select("pixel_id", "time", "event_id"), src.EVENT_SPLIT)


@query("split_sizes", f"WITH {L} SELECT {DAY_SPLIT_SQL} AS split, count(*) AS n FROM l GROUP BY 1")
def split_sizes(spark, sf):
    return splits.split_sizes(splits.fixed_split(src.daily_series(spark, sf), src.DAY_SPLIT))


@query("split_bounds", f"WITH {L} SELECT {DAY_SPLIT_SQL} AS split, min(time) AS first_time, max(time) AS last_time FROM l GROUP BY 1")
def split_bounds(spark, sf):
    return splits.split_bounds(splits.fixed_split(src.daily_series(spark, sf), src.DAY_SPLIT))


def _fold_summary(spark, df, folds):
    """Bounds and row counts per (fold, role)."""
    member = splits.assign_folds(df.select("time"), folds)
    return member.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("first_time"), F.max("time").alias("last_time")
    )


def _walk_sql(growing: bool) -> str:
    lo = "0" if growing else "s"
    return f"""WITH {L}, d AS (SELECT DISTINCT time FROM l WHERE time <= TIMESTAMP '2000-12-31'),
x AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM d),
c AS (SELECT count(*) AS n, greatest(count(*) // 3, 1) AS tw, greatest(count(*) // 6, 1) AS vw FROM d),
s AS (SELECT CAST(k + 1 AS INT) AS fold, k * vw AS s, tw, vw FROM c, generate_series(0, 50) g(k) WHERE k * vw + tw + vw <= n),
b AS (SELECT fold, 'train' AS role, {lo} AS a, s + tw AS z FROM s UNION ALL SELECT fold, 'val', s + tw, s + tw + vw FROM s)
SELECT fold, role, count(*) AS n, min(l.time) AS first_time, max(l.time) AS last_time
FROM b JOIN x ON i >= a AND i < z JOIN l ON l.time = x.time GROUP BY 1, 2"""


@query("rolling_folds", _walk_sql(False))
def rolling_folds(spark, sf):
    d = src.daily_series(spark, sf)
    return _fold_summary(spark, d, splits.rolling_folds(d, src.DAY_SPLIT))


@query("expanding_folds", _walk_sql(True))
def expanding_folds(spark, sf):
    d = src.daily_series(spark, sf)
    return _fold_summary(spark, d, splits.expanding_folds(d, src.DAY_SPLIT))


@query(
    "purged_cv_folds",
    f"""WITH {L}, d AS (SELECT DISTINCT time FROM l), x AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM d),
c AS (SELECT count(*) AS n, greatest(1, count(*) // 4) AS fs FROM d),
k AS (SELECT CAST(k AS INT) AS fold, k * fs AS te, k * fs + 5 AS vs, least(k * fs + 5 + fs, n) AS ve, n FROM c, generate_series(1, 3) g(k)),
b AS (SELECT fold, 'train' AS role, 0 AS a, te AS z FROM k WHERE ve > vs AND vs < n UNION ALL SELECT fold, 'val', vs, ve FROM k WHERE ve > vs AND vs < n)
SELECT fold, role, count(*) AS n, min(l.time) AS first_time, max(l.time) AS last_time
FROM b JOIN x ON i >= a AND i < z JOIN l ON l.time = x.time GROUP BY 1, 2""",
)
def purged_cv_folds(spark, sf):
    d = src.daily_series(spark, sf)
    return _fold_summary(spark, d, splits.purged_folds(d, 3, gap=5))


@query(
    "index_folds",
    """WITH x AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events),
k AS (SELECT x.*, CAST(k AS INT) AS fold, greatest(1, n // 4) AS fs FROM x, generate_series(1, 3) g(k))
SELECT fold, CASE WHEN i < fold * fs THEN 'train' ELSE 'val' END AS role, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id
FROM k WHERE i < least((fold + 1) * fs, n) GROUP BY 1, 2""",
)
def index_folds(spark, sf):
    member = splits.index_folds(src.table(spark, sf, "events").select("event_id"), "event_id", 3)
    return member.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")
    )


@query(
    "spatial_holdout",
    f"WITH {L} SELECT n_regionkey AS region_id, n_regionkey IN (1, 3) AS holdout, count(*) AS n, {rnd('avg(tp)', 'tp_mean')} "
    "FROM l JOIN supplier ON s_suppkey = pixel_id JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2",
)
def spatial_holdout(spark, sf):
    d = splits.spatial_holdout(src.with_region(spark, sf, src.daily_series(spark, sf)), "region_id", [1, 3])
    return tidy(d.groupBy("region_id", "holdout").agg(F.count(F.lit(1)).alias("n"), F.avg("tp").alias("tp_mean")))


@query(
    "region_membership",
    f"WITH {L}, j AS (SELECT l.*, n_regionkey AS region_id FROM l JOIN supplier ON s_suppkey = pixel_id JOIN nation ON n_nationkey = s_nationkey), "
    "h AS (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') "
    "SELECT 'holdout' AS part, count(*) AS n FROM j WHERE region_id IN (SELECT r_regionkey FROM h) UNION ALL "
    "SELECT 'in_sample', count(*) FROM j WHERE region_id NOT IN (SELECT r_regionkey FROM h)",
)
def region_membership(spark, sf):
    d = src.with_region(spark, sf, src.daily_series(spark, sf))
    held = src.table(spark, sf, "region").filter(F.col("r_name").startswith("A")).select(F.col("r_regionkey").alias("region_id"))
    inside, outside = splits.spatial_holdout_by(d, "region_id", held)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(outside, "holdout").unionByName(count(inside, "in_sample"))


# --- Scalers ------------------------------------------------------------------------------


def _scaled(spark, sf, kind):
    e = splits.fixed_split(src.event_series(spark, sf), src.EVENT_SPLIT)
    fitted = scaling.fit_scaler(e.filter("split = 'train'"), BANDS, kind)
    return tidy(fitted.transform(e).select("pixel_id", "time", "event_id", *BANDS))


def _scale_sql(centre: str, scale: str) -> str:
    fit = ", ".join(f"{centre.format(c=b)} AS m_{b}, {scale.format(c=b)} AS s_{b}" for b in BANDS)
    out = ", ".join(rnd(f"({b} - m_{b}) / CASE WHEN s_{b} = 0 THEN 1 ELSE s_{b} END", b) for b in BANDS)
    return f"WITH {E}, f AS (SELECT {fit} FROM e WHERE time <= TIMESTAMP '2024-01-20') SELECT {E_IDS}, {out} FROM e, f"


@query("scale_standard", _scale_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, sf):
    return _scaled(spark, sf, "standard")


@query("scale_minmax", _scale_sql("min({c})", "max({c}) - min({c})"))
def scale_minmax(spark, sf):
    return _scaled(spark, sf, "minmax")


@query("scale_robust", _scale_sql("median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def scale_robust(spark, sf):
    return _scaled(spark, sf, "robust")


# --- Metrics: persistence forecast y_pred = VP(x_t) against y_true = VP(x_{t+1}) -----------


def event_predictions(spark, sf) -> DataFrame:
    t = _event_targets(spark, sf, (1,)).filter(F.col("target_q1").isNotNull())
    return t.select("pixel_id", "time", F.col("target_q1").alias("y_true"), scores.vp("tp", "p90", "p95", "p100").alias("y_pred"))


def daily_predictions(spark, sf) -> DataFrame:
    d = src.daily_series(spark, sf)
    t = targets.add_targets(d, (1,), clim.climatology(d, "tp"), FuzzyConfig(mode=TargetMode.PIECEWISE))
    t = t.filter(F.col("target_q1").isNotNull())
    return t.select(
        "pixel_id", "time", F.col("target_q1").alias("y_true"),
        scores.vp("tp", "p90", "p95", "p100", TargetMode.PIECEWISE).alias("y_pred"),
    )


PE = (
    f"{E}, {thr('e')}, g AS (SELECT *, lead(tp) OVER ({KE}) AS nx FROM e), p AS (SELECT g.pixel_id, time, "
    f"{sql_sigmoid('nx')} AS y_true, {sql_sigmoid('tp')} AS y_pred FROM g LEFT JOIN thr USING (pixel_id) WHERE nx IS NOT NULL), "
    "b AS (SELECT *, CAST(y_true > 0.5 AS INT) AS e, CAST(y_pred > 0.5 AS INT) AS h, least(greatest(y_pred, 1e-7), 1 - 1e-7) AS q FROM p)"
)
PL = (
    f"{L}, {thr('l')}, g AS (SELECT *, lead(tp) OVER ({KL}) AS nx FROM l), p AS (SELECT g.pixel_id, time, "
    f"{sql_piecewise('nx')} AS y_true, {sql_piecewise('tp')} AS y_pred FROM g LEFT JOIN thr USING (pixel_id) WHERE nx IS NOT NULL), "
    "b AS (SELECT *, CAST(y_true > 0.5 AS INT) AS e, CAST(y_pred > 0.4 AS INT) AS h FROM p)"
)
COUNTS = (
    "CAST(count(*) FILTER (WHERE e = 1 AND h = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE e = 0 AND h = 1) AS DOUBLE) AS fp, "
    "CAST(count(*) FILTER (WHERE e = 0 AND h = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (WHERE e = 1 AND h = 0) AS DOUBLE) AS fn"
)


@query(
    "regression_metrics",
    f"WITH {PE} SELECT {rnd('avg((e - y_pred) ** 2)', 'brier')}, {rnd('sqrt(avg((y_true - y_pred) ** 2))', 'rmse')}, "
    f"{rnd('avg(abs(y_true - y_pred))', 'mae')}, {rnd('1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*))', 'r2')} FROM b",
)
def regression_metrics(spark, sf):
    return tidy(metrics.scalar_metrics(event_predictions(spark, sf), names=("brier", "rmse", "mae", "r2")))


@query(
    "classification_metrics",
    f"WITH {PE}, c AS (SELECT {COUNTS} FROM b) SELECT {rnds('tp', 'fp', 'tn', 'fn')}, "
    f"{rnd('(tp + tn) / (tp + tn + fp + fn)', 'accuracy')}, {rnd('tp / (tp + fp)', 'precision')}, {rnd('tp / (tp + fn)', 'recall')}, "
    f"{rnd('2 * tp / (2 * tp + fp + fn)', 'f1')}, {rnd('fp / greatest(fp + tn, 1)', 'fpr')}, {rnd('fn / greatest(fn + tp, 1)', 'fnr')} FROM c",
)
def classification_metrics(spark, sf):
    names = ("tp", "fp", "tn", "fn", "accuracy", "precision", "recall", "f1", "fpr", "fnr")
    return tidy(metrics.scalar_metrics(event_predictions(spark, sf), names=names))


@query(
    "smape",
    f"WITH {PE} SELECT {rnd('200.0 * avg(abs(y_true - y_pred) / (abs(y_true) + abs(y_pred))) FILTER (WHERE abs(y_true) + abs(y_pred) > 1e-12)', 'smape')} FROM p",
)
def smape(spark, sf):
    return tidy(metrics.scalar_metrics(event_predictions(spark, sf), names=("smape",)))


@query("log_loss", f"WITH {PE} SELECT {rnd('avg(-CASE WHEN e = 1 THEN ln(q) ELSE ln(1 - q) END)', 'log_loss')} FROM b")
def log_loss(spark, sf):
    return tidy(metrics.scalar_metrics(event_predictions(spark, sf), names=("log_loss",)))


_BCE_Q = "-(y_true * ln(q) + (1 - y_true) * ln(1 - q))"
_P_T = "(y_true * q + (1 - y_true) * (1 - q))"
_LN = "CASE WHEN {0} > 0 THEN greatest(ln({0}), -100.0) ELSE -100.0 END"


@query(
    "vp_losses",
    f"WITH {PE}, s AS (SELECT *, {_LN.format('y_pred')} AS lp, CASE WHEN y_pred < 1 THEN greatest(ln(1 - y_pred), -100.0) ELSE -100.0 END AS ln1, abs(y_pred - y_true) AS a FROM b) "
    f"SELECT {rnd('avg((y_pred - y_true) ** 2)', 'mse')}, {rnd('avg(-(y_true * lp + (1 - y_true) * ln1))', 'bce')}, "
    f"{rnd(f'avg((y_true * 0.25 + (1 - y_true) * 0.75) * (1 - {_P_T}) ** 2 * ({_BCE_Q}))', 'focal')}, "
    f"{rnd('avg(CASE WHEN a < 0.1 THEN 0.5 * a * a ELSE 0.1 * (a - 0.05) END)', 'huber')} FROM s",
)
def vp_losses(spark, sf):
    p = event_predictions(spark, sf)
    return tidy(p.agg(*[F.avg(loss(n, "y_true", "y_pred")).alias(n) for n in ("mse", "bce", "focal", "huber")]))


STEPS = (
    "s AS (SELECT y_pred AS score, CAST(sum(e) AS DOUBLE) AS pos, CAST(sum(1 - e) AS DOUBLE) AS neg FROM b GROUP BY 1), "
    "u AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS ctp, sum(neg) OVER (ORDER BY score DESC) AS cfp, sum(pos) OVER () AS pp, sum(neg) OVER () AS nn FROM s)"
)


@query("roc_auc", f"WITH {PE}, {STEPS} SELECT {rnd('sum(neg * (ctp - pos + pos / 2)) / (max(pp) * max(nn))', 'auc_roc')} FROM u")
def roc_auc(spark, sf):
    return tidy(metrics.ranking_metrics(event_predictions(spark, sf)).select("auc_roc"))


@query("average_precision", f"WITH {PE}, {STEPS} SELECT {rnd('sum(pos / pp * ctp / (ctp + cfp))', 'pr_auc')} FROM u")
def average_precision(spark, sf):
    return tidy(metrics.ranking_metrics(event_predictions(spark, sf)).select("pr_auc"))


@query(
    "ranking_by_period",
    f"WITH {PL}, k AS (SELECT b.*, CAST(year(time) AS INT) AS year FROM b), s AS (SELECT year, y_pred AS score, CAST(sum(e) AS DOUBLE) AS pos, CAST(sum(1 - e) AS DOUBLE) AS neg FROM k GROUP BY 1, 2), "
    "u AS (SELECT *, sum(pos) OVER (PARTITION BY year ORDER BY score DESC) AS ctp, sum(neg) OVER (PARTITION BY year ORDER BY score DESC) AS cfp, sum(pos) OVER (PARTITION BY year) AS pp, sum(neg) OVER (PARTITION BY year) AS nn FROM s) "
    f"SELECT year, {rnd('sum(neg * (ctp - pos + pos / 2)) / (max(pp) * max(nn))', 'auc_roc')}, {rnd('sum(pos / pp * ctp / (ctp + cfp))', 'pr_auc')} FROM u GROUP BY 1",
)
def ranking_by_period(spark, sf):
    p = daily_predictions(spark, sf).withColumn("year", F.year("time"))
    return tidy(metrics.ranking_metrics(p, by=("year",)))


# --- Calibration and report ---------------------------------------------------------------

GRID = ", ".join(f"({i}, CAST({t!r} AS DOUBLE))" for i, t in enumerate(alerts.threshold_grid()))
CURVE = (
    f"t(i, thr) AS (VALUES {GRID}), c AS (SELECT thr, CAST(count(*) FILTER (WHERE e = 1 AND y_pred > thr) AS DOUBLE) AS tp, "
    "CAST(count(*) FILTER (WHERE e = 0 AND y_pred > thr) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE e = 1 AND y_pred <= thr) AS DOUBLE) AS fn, "
    "CAST(count(*) FILTER (WHERE e = 0 AND y_pred <= thr) AS DOUBLE) AS tn FROM b, t GROUP BY 1)"
)


@query(
    "calibrate_f1",
    f"WITH {PE}, {CURVE} SELECT {rnd('thr', 'threshold')}, {rnd('2 * tp / (2 * tp + fp + fn)', 'score')} FROM c ORDER BY 2 * tp / (2 * tp + fp + fn) DESC, thr LIMIT 1",
)
def calibrate_f1(spark, sf):
    return tidy(alerts.calibrate(event_predictions(spark, sf), "f1"))


_J = "tp / greatest(tp + fn, 1) + tn / greatest(tn + fp, 1) - 1"


@query("calibrate_youden", f"WITH {PE}, {CURVE} SELECT {rnd('thr', 'threshold')}, {rnd(_J, 'score')} FROM c ORDER BY {_J} DESC, thr LIMIT 1")
def calibrate_youden(spark, sf):
    return tidy(alerts.calibrate(event_predictions(spark, sf), "youden"))


_PRF = "2 * (ctp / (ctp + cfp)) * (ctp / pp) / greatest(ctp / (ctp + cfp) + ctp / pp, 1e-8)"


@query("calibrate_pr", f"WITH {PE}, {STEPS} SELECT {rnd('score', 'threshold')}, {rnd(_PRF, 'score')} FROM u ORDER BY {_PRF} DESC, u.score LIMIT 1")
def calibrate_pr(spark, sf):
    return tidy(alerts.calibrate(event_predictions(spark, sf), "pr_auc"))


@query(
    "anomaly_labels",
    f"WITH {PE} SELECT pixel_id, time, e AS truth, CAST(y_pred > 0.3 AS INT) AS alert FROM b",
)
def anomaly_labels(spark, sf):
    p = alerts.classify(event_predictions(spark, sf), 0.3)
    return p.select("pixel_id", "time", scores.is_event("y_true").alias("truth"), "alert")


THRESHOLD = 0.4


@query(
    "confusion_matrix",
    f"WITH {PL}, c AS (SELECT {COUNTS} FROM b) SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp FROM c",
)
def confusion_matrix(spark, sf):
    return alerts.confusion_matrix(daily_predictions(spark, sf), THRESHOLD)


@query(
    "report_by_intensity",
    f"WITH {PL} SELECT CASE WHEN y_true <= 0 THEN 'below_p90' WHEN y_true <= 0.5 THEN 'p90_to_p95' WHEN y_true < 1 THEN 'p95_to_p100' ELSE 'above_p100' END AS band, "
    f"count(*) AS count, {rnd('avg(y_pred)', 'mean_pred')}, {rnd('avg(abs(y_true - y_pred))', 'mae')}, {rnd('sqrt(avg((y_true - y_pred) ** 2))', 'rmse')}, {rnd('avg(y_true - y_pred)', 'bias')} FROM p GROUP BY 1",
)
def report_by_intensity(spark, sf):
    return tidy(alerts.by_intensity(daily_predictions(spark, sf)))


@query(
    "report_by_season",
    f"WITH {PL}, k AS (SELECT CASE WHEN month(time) IN (12, 1, 2) THEN 'DJF_wet' WHEN month(time) IN (3, 4, 5) THEN 'MAM_trans' WHEN month(time) IN (6, 7, 8) THEN 'JJA_dry' ELSE 'SON_trans' END AS season, b.* FROM b), "
    f"c AS (SELECT season, count(*) AS count, avg(e) AS anomaly_rate, {COUNTS} FROM k GROUP BY 1) SELECT season, count, {rnds('anomaly_rate')}, "
    f"{rnd('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END', 'precision')}, {rnd('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END', 'recall')}, "
    f"{rnd('CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END', 'f1')} FROM c",
)
def report_by_season(spark, sf):
    return tidy(alerts.by_season(daily_predictions(spark, sf), THRESHOLD))


_QS = (("q05", 0.05), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q95", 0.95))


@query(
    "residual_profile",
    f"WITH {PL}, d AS (SELECT y_true - y_pred AS r FROM p) SELECT {rnd('avg(r)', 'mean')}, {rnd('stddev_pop(r)', 'std')}, {rnd('skewness(r)', 'skewness')}, "
    f"{rnd('kurtosis(r)', 'kurtosis')}, " + ", ".join(rnd(f"quantile_cont(r, {q})", n) for n, q in _QS) + " FROM d",
)
def residual_profile(spark, sf):
    return tidy(alerts.residual_profile(daily_predictions(spark, sf)))


def _long_sql(table: str, part: str, names: Sequence[str], key: str = "''") -> str:
    return " UNION ALL ".join(f"SELECT run, '{part}' AS part, {key} AS key, '{n}' AS name, {rnd(n, 'value')} FROM {table}" for n in names)


_REPORT_PARTS = {
    "confusion": ("tn", "fp", "fn", "tp"), "overall": ("precision", "recall", "f1", "fpr", "roc_auc"), "intensity": ("count", "mae", "bias"),
    "seasons": ("count", "anomaly_rate", "f1"), "residuals": ("mean", "std", "skewness", "kurtosis", *[n for n, _ in _QS]),
}
REPORT_GRID_SQL = (
    f"WITH {PL}, g2 AS (SELECT pixel_id % 4 AS run, p.*, CAST(y_true > 0.5 AS INT) AS e, CAST(y_pred > 0.3 + 0.05 * (pixel_id % 4) AS INT) AS h FROM p), "
    f"c AS (SELECT run, {COUNTS} FROM g2 GROUP BY 1), "
    "s AS (SELECT run, y_pred, sum(e) AS pos, sum(1 - e) AS neg FROM g2 GROUP BY 1, 2), "
    "u AS (SELECT *, sum(pos) OVER (PARTITION BY run ORDER BY y_pred DESC) AS ctp, sum(pos) OVER (PARTITION BY run) AS pp, sum(neg) OVER (PARTITION BY run) AS nn FROM s), "
    "auc AS (SELECT run, sum(neg * (ctp - pos + pos / 2)) / (max(pp) * max(nn)) AS roc_auc FROM u GROUP BY 1), "
    "o AS (SELECT c.run, roc_auc, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, "
    "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, fp / greatest(fp + tn, 1.0) AS fpr FROM c JOIN auc USING (run)), "
    "i AS (SELECT run, CASE WHEN y_true <= 0 THEN 'below_p90' WHEN y_true <= 0.5 THEN 'p90_to_p95' WHEN y_true < 1 THEN 'p95_to_p100' ELSE 'above_p100' END AS band, "
    "count(*) AS count, avg(abs(y_true - y_pred)) AS mae, avg(y_true - y_pred) AS bias FROM g2 GROUP BY 1, 2), "
    "k AS (SELECT CASE WHEN month(time) IN (12, 1, 2) THEN 'DJF_wet' WHEN month(time) IN (3, 4, 5) THEN 'MAM_trans' WHEN month(time) IN (6, 7, 8) THEN 'JJA_dry' ELSE 'SON_trans' END AS season, g2.* FROM g2), "
    f"z AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM (SELECT run, season, count(*) AS count, avg(e) AS anomaly_rate, {COUNTS} FROM k GROUP BY 1, 2)), "
    "r AS (SELECT run, avg(y_true - y_pred) AS mean, stddev_pop(y_true - y_pred) AS std, skewness(y_true - y_pred) AS skewness, kurtosis(y_true - y_pred) AS kurtosis, "
    + ", ".join(f"quantile_cont(y_true - y_pred, {q}) AS {n}" for n, q in _QS) + " FROM g2 GROUP BY 1) "
    + " UNION ALL ".join([
        _long_sql("c", "confusion", _REPORT_PARTS["confusion"]), _long_sql("o", "overall", _REPORT_PARTS["overall"]), _long_sql("i", "intensity", _REPORT_PARTS["intensity"], "band"),
        _long_sql("z", "seasons", _REPORT_PARTS["seasons"], "season"), _long_sql("r", "residuals", _REPORT_PARTS["residuals"]),
    ])
)


@query("report_grid", REPORT_GRID_SQL)
def report_grid(spark, sf):
    """The reports of four runs with thresholds of their own, each part from one grouped job; one row per number."""
    runs = pin(daily_predictions(spark, sf).withColumn("run", F.col("pixel_id") % 4))
    report = alerts.grouped_reports(runs, ["run"], F.lit(0.3) + 0.05 * F.col("run"))
    frames = {"confusion": report.confusion, "overall": report.overall, "intensity": report.intensity, "seasons": report.seasons, "residuals": report.residuals}
    keys = {"intensity": F.col("band"), "seasons": F.col("season")}

    def long(part: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in _REPORT_PARTS[part]]))
        return frames[part].select("run", F.lit(part).alias("part"), keys.get(part, F.lit("")).alias("key"), each.alias("v")).select("run", "part", "key", "v.*")

    return tidy(functools.reduce(DataFrame.union, [long(part) for part in _REPORT_PARTS]))


# --- Checks -------------------------------------------------------------------------------


def _checked_table(spark, sf):
    e = src.event_series(spark, sf)
    cfg = FeatureConfig(bands=BANDS, rolling_windows=(3,), include_spatial_coords=False, include_temporal=False)
    df, meta = targets.features_and_targets(e, 3, cfg, (1,), clim.climatology(e, "tp"), keys=src.EVENT_KEYS)
    return df.dropna(subset=["target_q1"]), meta


CHECK_SPECS = [*feat.lag_specs(BANDS, 3), *feat.rolling_specs(BANDS, (3,), ("mean", "std"))]
CHECK_CTE = (
    f"{E}, {thr('e')}, w AS (SELECT e.*, "
    + ", ".join(f"{x} AS {n}" for n, x in sql_features(CHECK_SPECS, KE).items())
    + f", lead(tp) OVER ({KE}) AS nx FROM e), k AS (SELECT w.*, {sql_sigmoid('nx')} AS y, {EVENT_SPLIT_SQL} AS split FROM w LEFT JOIN thr USING (pixel_id) "
    + "WHERE nx IS NOT NULL AND " + " AND ".join(f"{s.name} IS NOT NULL" for s in CHECK_SPECS) + ")"
)


PAIRS = (("train", "val"), ("train", "test"), ("val", "test"))


def _names_sql(names: Sequence[str]) -> str:
    listed = ", ".join(f"('{n}')" for n in names)
    return f"(SELECT count(*) = 0 FROM (VALUES {listed}) v(n) WHERE regexp_matches(lower(n), 'target|future|label'))"


def _check_row(name: str, ok: str) -> str:
    return f"SELECT '{name}' AS \"check\", {ok} AS ok FROM a"


@query(
    "check_battery",
    f"WITH {CHECK_CTE}, a AS (SELECT max(time) FILTER (WHERE split = 'train') AS t1, min(time) FILTER (WHERE split = 'val') AS v0, max(time) FILTER (WHERE split = 'val') AS v1, "
    "min(time) FILTER (WHERE split = 'test') AS s0, count(*) FILTER (WHERE split = 'train') AS n1, count(*) FILTER (WHERE split = 'val') AS n2, count(*) FILTER (WHERE split = 'test') AS n3, "
    + ", ".join(f"count(*) FILTER (WHERE split = '{a}' AND split = '{b}') AS {a}_{b}" for a, b in PAIRS)
    + ", " + " + ".join(f"count(*) FILTER (WHERE {s.name} IS NULL)" for s in CHECK_SPECS) + " AS nulls, "
    "min(y) AS lo, max(y) AS hi FROM k) "
    + " UNION ALL ".join(
        _check_row(n, ok)
        for n, ok in (
            ("no_future_names", _names_sql([s.name for s in CHECK_SPECS])), ("train_before_val", "t1 < v0"), ("val_before_test", "v1 < s0"),
            *((f"disjoint_{a}_{b}", f"{a}_{b} = 0") for a, b in PAIRS),
            ("train_not_empty", "n1 > 0"), ("val_not_empty", "n2 > 0"), ("test_not_empty", "n3 > 0"),
            ("no_null_features", "nulls = 0"), ("target_in_range", "lo >= 0 AND hi <= 1"),
        )
    ),
)
def check_battery(spark, sf):
    df, meta = _checked_table(spark, sf)
    labelled = splits.fixed_split(df, src.EVENT_SPLIT)
    return quality.check_battery(labelled, meta.names, "target_q1", quality.split_masks()).select("check", "ok")


@query(
    "check_battery_failing",
    f"WITH {CHECK_CTE}, p AS (SELECT *, CASE WHEN event_id % 10 > 0 THEN y END AS future_tp, 2 * y AS doubled, time <= TIMESTAMP '2024-01-22' AS tr, "
    "time > TIMESTAMP '2024-01-20' AND time <= TIMESTAMP '2024-01-25' AS va, time > TIMESTAMP '2025-01-01' AS te FROM k), "
    "a AS (SELECT max(time) FILTER (WHERE tr) AS t1, min(time) FILTER (WHERE va) AS v0, max(time) FILTER (WHERE va) AS v1, min(time) FILTER (WHERE te) AS s0, "
    "count(*) FILTER (WHERE tr) AS n1, count(*) FILTER (WHERE va) AS n2, count(*) FILTER (WHERE te) AS n3, count(*) FILTER (WHERE tr AND va) AS train_val, "
    "count(*) FILTER (WHERE tr AND te) AS train_test, count(*) FILTER (WHERE va AND te) AS val_test, count(*) FILTER (WHERE future_tp IS NULL) AS nulls, "
    "min(doubled) AS lo, max(doubled) AS hi FROM p) "
    + " UNION ALL ".join(
        _check_row(n, f"coalesce({ok}, FALSE)")
        for n, ok in (
            ("no_future_names", _names_sql(["lag_0_tp", "future_tp"])), ("train_before_val", "t1 < v0"), ("val_before_test", "v1 < s0"),
            *((f"disjoint_{a}_{b}", f"{a}_{b} = 0") for a, b in PAIRS),
            ("train_not_empty", "n1 > 0"), ("val_not_empty", "n2 > 0"), ("test_not_empty", "n3 > 0"),
            ("no_null_features", "nulls = 0"), ("target_in_range", "lo >= 0 AND hi <= 1"),
        )
    ),
)
def check_battery_failing(spark, sf):
    """The same battery on a table that breaks most of its rules."""
    df, _ = _checked_table(spark, sf)
    df = df.withColumns({"future_tp": F.when(F.col("event_id") % 10 > 0, F.col("target_q1")), "doubled": 2 * F.col("target_q1")})
    at = lambda day: clim.instant(day)
    masks = {
        "train": F.col("time") <= at("2024-01-22"), "val": (F.col("time") > at("2024-01-20")) & (F.col("time") <= at("2024-01-25")),
        "test": F.col("time") > at("2025-01-01"),
    }
    return quality.check_battery(df, ["lag_0_tp", "future_tp"], "doubled", masks).select("check", "ok")


@query(
    "rolling_test_rows",
    f"WITH {L} SELECT time, pixel_id FROM l WHERE time > TIMESTAMP '2000-12-31'",
)
def rolling_test_rows(spark, sf):
    """Rows held out from every fold of the walk-forward splits."""
    d = src.daily_series(spark, sf)
    return d.filter(splits.test_rows(src.DAY_SPLIT)).select("time", "pixel_id")


@query(
    "lag_integrity",
    f"WITH {CHECK_CTE}, g AS (SELECT *, "
    + ", ".join(f"{sql_lag(s.lag, s.band, KE)} AS again_{s.name}" for s in CHECK_SPECS if s.kind == "lag")
    + " FROM k) "
    + " UNION ALL ".join(
        f"SELECT '{s.name}' AS feature, count(again_{s.name}) AS compared, count(*) FILTER (WHERE abs({s.name} - again_{s.name}) > 1e-8 + 1e-5 * abs(again_{s.name})) AS mismatches FROM g"
        for s in CHECK_SPECS if s.kind == "lag"
    ),
)
def lag_integrity(spark, sf):
    df, meta = _checked_table(spark, sf)
    return quality.lag_integrity(df, meta.specs, src.EVENT_KEYS)


@query(
    "feature_target_corr",
    f"WITH {CHECK_CTE}, c AS (SELECT "
    + ", ".join(f"corr({s.name}, y) AS c_{s.name}" for s in CHECK_SPECS)
    + " FROM k) "
    + " UNION ALL ".join(f"SELECT '{s.name}' AS feature, {rnd(f'c_{s.name}', 'correlation')}, abs(c_{s.name}) > 0.99 AS alert FROM c" for s in CHECK_SPECS),
)
def feature_target_corr(spark, sf):
    df, meta = _checked_table(spark, sf)
    return tidy(quality.target_correlation(df, meta.names, "target_q1"))


@query(
    "null_counts",
    f"WITH {E}, w AS (SELECT " + ", ".join(f"{x} AS {n}" for n, x in sql_features(CHECK_SPECS, KE).items()) + " FROM e) "
    + " UNION ALL ".join(f"SELECT '{s.name}' AS feature, count(*) - count({s.name}) AS nulls FROM w" for s in CHECK_SPECS),
)
def null_counts(spark, sf):
    """Missing values per feature before incomplete rows are dropped."""
    view = feat.ordered_view(src.event_series(spark, sf), ["pixel_id"], src.EVENT_KEYS.order, before=3)
    wide = view.finish(feat.window_features(view, CHECK_SPECS))
    return quality.null_counts(wide, [s.name for s in CHECK_SPECS])


@query("key_uniqueness", "SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def key_uniqueness(spark, sf):
    return quality.duplicate_keys(src.table(spark, sf, "orders"), ["o_custkey", "o_orderdate"])


# --- Sampling, distinct, summary ----------------------------------------------------------


@query(
    "hash_sample",
    f"WITH {E} SELECT * FROM e WHERE ('0x' || substr(md5(event_id::VARCHAR || '|42'), 1, 13))::BIGINT / 4503599627370496.0 < 0.1",
)
def sampled(spark, sf):
    return hash_sample(src.event_series(spark, sf), 0.1, ["event_id"], seed=42)


@query("distinct_times", f"WITH {L} SELECT DISTINCT time FROM l")
def distinct_times(spark, sf):
    return splits.distinct_times(src.daily_series(spark, sf))


@query(
    "raw_band_merge",
    sql_table([E], "e", E_IDS, sql_features(feat.lag_specs(("tp",), 3), KE)).replace(
        "FROM w WHERE", "FROM w JOIN (SELECT DISTINCT event_id AS id, t2m FROM e) m ON m.id = w.event_id WHERE"
    ).replace(f"SELECT {E_IDS}, round", f"SELECT {E_IDS}, t2m, round"),
)
def raw_band_merge(spark, sf):
    """Features joined back to the distinct raw bands; the base table avoids this join."""
    e = src.event_series(spark, sf)
    cfg = FeatureConfig(bands=("tp",), include_rolling=False, include_spatial_coords=False, include_temporal=False)
    f, _ = feat.build_features(e, 3, cfg, keys=src.EVENT_KEYS, keep=("event_id",))
    raw = e.select("pixel_id", "time", "event_id", "t2m").dropDuplicates()
    return tidy(f.join(raw, ["pixel_id", "time", "event_id"], "left"))


@query(
    "summary_union",
    f"WITH {PE}, {STEPS.replace('s AS', 's1 AS', 1).replace('FROM s)', 'FROM s1)')} "
    f"SELECT 'scalar' AS part, {rnd('(SELECT avg(abs(y_true - y_pred)) FROM p)', 'mae')}, CAST(NULL AS DOUBLE) AS auc_roc UNION ALL "
    f"SELECT 'ranking', CAST(NULL AS DOUBLE), round((SELECT sum(neg * (ctp - pos + pos / 2)) / (max(pp) * max(nn)) FROM u), 6) + 0.0",
)
def summary_union(spark, sf):
    """Result rows with different columns stacked into one summary."""
    p = event_predictions(spark, sf)
    a = metrics.scalar_metrics(p, names=("mae",)).withColumn("part", F.lit("scalar"))
    b = metrics.ranking_metrics(p).select(F.lit("ranking").alias("part"), "auc_roc")
    return tidy(append_summary(append_summary(None, a), b).select("part", "mae", "auc_roc"))


# --- Sources ------------------------------------------------------------------------------

NAMES = """o AS (SELECT o_orderkey, CASE o_orderkey % 4
  WHEN 0 THEN 'cube/era5_cube_' || strftime(o_orderdate, '%Y%m%d') || '.tif'
  WHEN 1 THEN 'era5_cube_' || strftime(o_orderdate, '%Y%m%d') || '_' || lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') || '.tif'
  WHEN 2 THEN 'a/b/' || strftime(o_orderdate, 'M%m_D%d_%Y_H') || lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') || '_' || lower(substr(o_orderpriority, 3, 3)) || '.tif'
  ELSE 'random_file_' || CAST(o_orderkey % 7 AS VARCHAR) || '.tif' END AS path,
  CASE o_orderkey % 4 WHEN 0 THEN date_trunc('day', o_orderdate)
  WHEN 3 THEN NULL ELSE date_trunc('day', o_orderdate) + to_hours(CAST(o_custkey % 24 AS INT)) END AS time,
  CASE WHEN o_orderkey % 4 = 2 THEN lower(substr(o_orderpriority, 3, 3)) END AS band FROM orders)"""


@query("timestamp_parse", f"WITH {NAMES} SELECT o_orderkey, path, CAST(time AS TIMESTAMP) AS time FROM o")
def timestamp_parse(spark, sf):
    return src.stamped_names(spark, sf).withColumn("time", file_time("path"))


@query(
    "band_parse",
    f"WITH {NAMES} SELECT o_orderkey, band, CAST(CASE WHEN band IS NOT NULL THEN time END AS TIMESTAMP) AS time FROM o",
)
def band_parse(spark, sf):
    desc = F.regexp_replace("path", r"\.tif$", "")
    return src.stamped_names(spark, sf).select("o_orderkey", band_name(desc).alias("band"), band_time(desc).alias("time"))


@query("file_listing", f"WITH {NAMES} SELECT DISTINCT path, CAST(time AS TIMESTAMP) AS time FROM o WHERE time IS NOT NULL")
def file_listing(spark, sf):
    return tiles.list_files(src.stamped_names(spark, sf))


V = """v AS (SELECT vec_id, embedding, vec_id // 10 AS f, CAST(vec_id % 10 AS INT) AS b FROM embeddings),
x AS (SELECT vec_id, f, b, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS pos, unnest(embedding) AS val FROM v)"""
TILE_ROWS = (
    V + ", t AS (SELECT x.*, f % 5 = 4 AS unnamed, CASE WHEN f % 5 = 4 THEN TIMESTAMP '2024-01-01 06:00:00' + to_days(CAST(f AS INT)) + to_hours(b) "
    "ELSE TIMESTAMP '2024-01-01' + to_days(CAST(f AS INT)) + to_hours(b // 2) END AS time, pos // 8 AS y, pos % 8 AS xx, "
    "CASE WHEN abs(val) < 0.005 THEN NULL ELSE val END AS c FROM x WHERE f % 7 <> 3)"
)


@query(
    "tile_to_long",
    f"WITH {TILE_ROWS} SELECT time, CAST((y // 2) * 4 + xx // 2 AS BIGINT) AS pixel_id, CAST(y // 2 AS INT) AS y_idx, CAST(xx // 2 AS INT) AS x_idx, {rnd('c', 'tp')} "
    "FROM t WHERE (unnamed OR b % 2 = 0) AND y % 2 = 0 AND xx % 2 = 0 AND c IS NOT NULL",
)
def tile_to_long(spark, sf):
    return tidy(tiles.pixel_series(src.vector_tiles(spark, sf), ("tp",), stride=2))


@query(
    "cube_rows",
    f"WITH {TILE_ROWS} SELECT time, CAST(y * 8 + xx AS BIGINT) AS pixel_id, CAST(y AS INT) AS y_idx, CAST(xx AS INT) AS x_idx, "
    f"{rnd('max(c) FILTER (WHERE unnamed OR b % 2 = 0)', 'tp')}, {rnd('max(c) FILTER (WHERE NOT unnamed AND b % 2 = 1)', 't2m')} FROM t GROUP BY f, time, y, xx",
)
def cube_rows(spark, sf):
    return tidy(tiles.cube_rows(src.vector_tiles(spark, sf), BANDS))


@query(
    "stride_grid",
    f"WITH {V} SELECT vec_id, CAST((pos // 8 // 3) * 3 + pos % 8 // 3 AS BIGINT) AS pixel_id, CAST(pos // 8 // 3 AS INT) AS y_idx, CAST(pos % 8 // 3 AS INT) AS x_idx, {rnd('val', 'p95')} "
    "FROM x WHERE pos // 8 % 3 = 0 AND pos % 8 % 3 = 0",
)
def stride_grid(spark, sf):
    """Every embedding as a one-band raster, every third row and column kept."""
    v = src.table(spark, sf, "embeddings").select("vec_id", F.lit(8).alias("width"), F.col("embedding").alias("values"))
    return tidy(tiles.value_grid(v, "p95", 3, carry=("vec_id",)))


@query(
    "monthly_scan",
    f"WITH {V} SELECT CAST(TIMESTAMP '1995-01-01' + to_months(CAST(f AS INT)) + to_hours(b) AS TIMESTAMP) AS time, CAST(pos AS BIGINT) AS pixel_id, "
    f"CAST(pos // 8 AS INT) AS y_idx, CAST(pos % 8 AS INT) AS x_idx, {rnd('val', 'precipitation')} FROM x WHERE f % 9 <> 8",
)
def monthly_scan(spark, sf):
    return tidy(tiles.monthly_series(src.monthly_tiles(spark, sf)))


@query(
    "climatology_cube",
    f"WITH {V} SELECT CAST(pos AS BIGINT) AS pixel_id, {rnd('quantile_cont(CAST(val AS DOUBLE), 0.95)', 'p95')} FROM x "
    "WHERE f % 9 <> 8 AND TIMESTAMP '1995-01-01' + to_months(CAST(f AS INT)) + to_hours(b) <= TIMESTAMP '1997-06-30' GROUP BY 1",
)
def climatology_cube(spark, sf):
    """Monthly files to a p95 map over the training years."""
    return tidy(clim.train_climatology(tiles.monthly_series(src.monthly_tiles(spark, sf)), "precipitation", "1997-06-30"))


FILES = (
    "f AS (SELECT DISTINCT vec_id // 10 AS f FROM embeddings), m AS (SELECT 'grid/era5_cube_' || strftime(DATE '2024-01-01' + CAST(f AS INT), '%Y%m%d') || "
    "CASE WHEN f % 5 = 4 THEN '_06.tif' ELSE '.tif' END AS path, f FROM f)"
)


@query(
    "alignment_check",
    f"WITH {FILES} SELECT path, 'crs' AS issue FROM m WHERE f % 11 = 5 UNION ALL SELECT path, 'shape' FROM m WHERE f % 7 = 3",
)
def alignment_check(spark, sf):
    return tiles.alignment_issues(tiles.file_metadata(src.vector_tiles(spark, sf)))


@query(
    "file_metadata",
    f"WITH {FILES}, n AS (SELECT vec_id // 10 AS f, count(*) AS count FROM embeddings GROUP BY 1) SELECT path, CASE WHEN m.f % 11 = 5 THEN 'EPSG:31983' ELSE 'EPSG:4326' END AS crs, "
    f"CAST(CASE WHEN m.f % 7 = 3 THEN 4 ELSE 8 END AS INT) AS height, CAST(CASE WHEN m.f % 7 = 3 THEN 16 ELSE 8 END AS INT) AS width, {rnd('-9999.0', 'nodata')}, count FROM m JOIN n USING (f)",
)
def file_metadata(spark, sf):
    return tidy(tiles.file_metadata(src.vector_tiles(spark, sf)).drop("transform"))


@query(
    "period_batches",
    """WITH t AS (SELECT l_quantity, TIMESTAMP '1995-03-10' + to_days(CAST(date_diff('day', TIMESTAMP '1995-03-10', l_shipdate) // 15 * 15 AS INT)) AS s FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1995-03-10' AND l_shipdate < TIMESTAMP '2001-05-01')
SELECT CAST(s AS TIMESTAMP) AS batch_start, CAST(least(s + to_days(15), TIMESTAMP '2001-05-01') AS TIMESTAMP) AS batch_end, count(*) AS n, """
    + rnd("sum(l_quantity)", "qty") + " FROM t GROUP BY 1, 2",
)
def period_batches(spark, sf):
    li = src.table(spark, sf, "lineitem").select("l_shipdate", "l_quantity")
    b = tiles.period_batches(li, "1995-03-10", "2001-05-01", 15, "l_shipdate")
    return tidy(b.groupBy("batch_start", "batch_end").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty")))


@query(
    "month_batches",
    """WITH t AS (SELECT greatest(date_trunc('month', l_shipdate), TIMESTAMP '1995-03-10') AS s, date_trunc('month', l_shipdate) + to_months(1) AS e FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1995-03-10' AND l_shipdate < TIMESTAMP '2001-05-20')
SELECT CAST(s AS TIMESTAMP) AS batch_start, CAST(least(e, TIMESTAMP '2001-05-20') AS TIMESTAMP) AS batch_end, count(*) AS n FROM t GROUP BY 1, 2""",
)
def month_batches(spark, sf):
    li = src.table(spark, sf, "lineitem").select("l_shipdate")
    b = tiles.period_batches(li, "1995-03-10", "2001-05-20", None, "l_shipdate")
    return b.groupBy("batch_start", "batch_end").agg(F.count(F.lit(1)).alias("n"))


ROI = (
    '{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": '
    "[[[-52.0, -25.0], [-47.5, -25.5], [-46.0, -22.0], [-50.0, -20.5], [-52.0, -25.0]]]}}]}"
)


@query(
    "bbox_filter",
    f"WITH {E}, g AS (SELECT event_id, -54.0 + 0.5 * x_idx AS lon, -26.0 + 0.5 * (y_idx % 16) AS lat, tp FROM e) "
    f"SELECT event_id, {rnds('lon', 'lat', 'tp')} FROM g WHERE lon BETWEEN -52.0 AND -46.0 AND lat BETWEEN -25.5 AND -20.5",
)
def bbox_filter(spark, sf):
    e = src.event_series(spark, sf)
    g = e.select("event_id", (F.lit(-54.0) + 0.5 * F.col("x_idx")).alias("lon"), (F.lit(-26.0) + 0.5 * (F.col("y_idx") % 16)).alias("lat"), "tp")
    return tidy(tiles.within_bounds(g, tiles.roi_bounds(ROI)))


@query(
    "source_select",
    f"SELECT l_shipdate AS time, l_orderkey, l_linenumber, {rnd('l_quantity * 1000', 'tp')}, {rnd('l_discount', 't2m')} FROM lineitem "
    "WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01'",
)
def source_select(spark, sf):
    """Date range and variables under short names at the source; metres become millimetres."""
    li = src.table(spark, sf, "lineitem").withColumnRenamed("l_shipdate", "time")
    chosen = tiles.select_period(li, "1996-01-01", "1998-01-01", {"l_quantity": "tp", "l_discount": "t2m"}, carry=("l_orderkey", "l_linenumber"))
    return tidy(tiles.metres_to_mm(chosen, ["tp"]))


PATCH_SQL = f"""WITH {TILE_ROWS}, cube AS (SELECT time, CAST(y AS INT) AS y, CAST(xx AS INT) AS x, max(c) FILTER (WHERE unnamed OR b % 2 = 0) AS tp,
max(c) FILTER (WHERE NOT unnamed AND b % 2 = 1) AS t2m FROM t GROUP BY f, time, y, xx),
ti AS (SELECT time, row_number() OVER (ORDER BY time) AS i FROM (SELECT DISTINCT time FROM cube)),
ci AS (SELECT cube.*, i FROM cube JOIN ti USING (time)),
ctr AS (SELECT time, y AS cy, x AS cx, i FROM ci WHERE y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AND i >= 2),
cell AS (SELECT ctr.time, cy, cx, ci.i AS step, ci.y, ci.x, coalesce(CAST(CAST(round(CAST(tp AS DOUBLE) * 10000) AS BIGINT) AS VARCHAR), 'n') || ',' ||
coalesce(CAST(CAST(round(CAST(t2m AS DOUBLE) * 10000) AS BIGINT) AS VARCHAR), 'n') AS v
FROM ctr JOIN ci ON ci.i BETWEEN ctr.i - 1 AND ctr.i AND ci.y BETWEEN cy - 1 AND cy + 1 AND ci.x BETWEEN cx - 1 AND cx + 1)
SELECT time, cy, cx, string_agg(v, ',' ORDER BY step, y, x) AS patch FROM cell GROUP BY 1, 2, 3"""


@query("patch_tensor", PATCH_SQL)
def patch_tensor(spark, sf):
    """Two-step 3×3 patches of both bands over every raster; values as ten-thousandths in text."""
    cube = tiles.cube_rows(src.vector_tiles(spark, sf), BANDS)
    text = F.transform("patch", lambda v: F.coalesce(F.round(v.cast("double") * 10000).cast("long").cast("string"), F.lit("n")))
    return build_patches(cube, 2, 1, BANDS, 8, 8).withColumn("patch", F.array_join(text, ","))


PATCH_INDEX_SQL = PATCH_SQL[: PATCH_SQL.index("ctr AS")] + (
    "ctr AS (SELECT time, y AS cy, x AS cx, i FROM ci WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5 AND i >= 3), "
    "full_cells AS (SELECT ctr.time, cy, cx, count(*) AS n FROM ctr JOIN ci ON ci.i BETWEEN ctr.i - 2 AND ctr.i "
    "AND ci.y BETWEEN cy - 2 AND cy + 2 AND ci.x BETWEEN cx - 2 AND cx + 2 GROUP BY 1, 2, 3) "
    "SELECT row_number() OVER (ORDER BY time, cy, cx) - 1 AS sample, time, cy, cx FROM full_cells WHERE n = 75"
)


@query("patch_index", PATCH_INDEX_SQL)
def patch_index(spark, sf):
    """The numbers of three-step 5×5 patches and what they stand for."""
    cube = tiles.cube_rows(src.vector_tiles(spark, sf), BANDS)
    return number_patches(build_patches(cube, 3, 2, BANDS, 8, 8)).drop("patch")


# --- Models -------------------------------------------------------------------------------


def model_table(spark, sf) -> tuple[DataFrame, list[str]]:
    """Features, target and split of the event series, scaled on training rows."""
    e = src.event_series(spark, sf)
    cfg = FeatureConfig(bands=BANDS, rolling_windows=(3,), include_spatial_coords=False, include_temporal=False)
    df, meta = targets.features_and_targets(e, 3, cfg, (1,), clim.climatology(e, "tp"), keys=src.EVENT_KEYS)
    df = splits.fixed_split(df.dropna(subset=["target_q1"]), src.EVENT_SPLIT)
    df = df.select("pixel_id", "time", "event_id", *meta.names, "target_q1", "split")
    return df, meta.names


def _model_query(name: str, only: Sequence[str] = (), digits: int = 6, **params) -> Query:
    """Fit on the training rows, score the test rows; ``only`` narrows the features."""

    def run(spark, sf):
        df, features = model_table(spark, sf)
        features = list(only) or features
        # Scaler, fit and scoring all read the table: compute it once.
        df = pin(df)
        df = scaling.fit_scaler(df.filter("split = 'train'"), features).transform(df)
        train = df.filter("split = 'train'")
        fitted = fit_model(name, train, features, "target_q1", **params)
        out = score(fitted, df.filter("split = 'test'"))
        return tidy(out.select("pixel_id", "time", "event_id", "target_q1", "y_pred"), digits)

    return run


TEST_ROWS = f"WITH {CHECK_CTE} SELECT pixel_id, time, event_id, {rnd('y', 'target_q1')}, {{pred}} FROM k WHERE split = 'test'"

query("dummy_mean", TEST_ROWS.format(pred=rnd("(SELECT avg(y) FROM k WHERE split = 'train')", "y_pred")))(_model_query("DummyMean"))
query("dummy_median", TEST_ROWS.format(pred=rnd("(SELECT median(y) FROM k WHERE split = 'train')", "y_pred")))(_model_query("DummyMedian"))
query("ridge")(_model_query("Ridge"))
query("lasso")(_model_query("Lasso", alpha=0.001))
query("elastic_net")(_model_query("ElasticNet", alpha=0.001))
query("bayes_ridge")(_model_query("BayesianRidge"))
query("pls")(_model_query("PLSRegression"))
query("transformed_target")(_model_query("TransformedTarget_Ridge"))
query("extra_tree")(_model_query("ExtraTree"))
query("linear_svr")(_model_query("LinearSVR"))
query("tree")(_model_query("DecisionTree"))
query("forest")(_model_query("RandomForest", n_estimators=20, max_depth=8))
query("gbt")(_model_query("GradientBoosting", n_estimators=10, max_depth=4))


# With one or two standardised features the fits have closed forms that SQL can state.
ONE = ("lag_0_tp",)
TWO = ("lag_0_tp", "lag_1_tp")
FIT_SQL = (
    f"WITH {CHECK_CTE}, m AS (SELECT avg(lag_0_tp) AS m0, stddev_pop(lag_0_tp) AS s0, avg(lag_1_tp) AS m1, stddev_pop(lag_1_tp) AS s1, avg(y) AS my FROM k WHERE split = 'train'), "
    "z AS (SELECT k.*, (lag_0_tp - m0) / s0 AS a, (lag_1_tp - m1) / s1 AS b, my FROM k, m), "
    "c AS (SELECT count(*) AS n, sum(a * (y - my)) AS ay, sum(b * (y - my)) AS bb, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS b2 FROM z WHERE split = 'train')"
)


def _fit_sql(value: str, digits: int) -> str:
    return (
        f"{FIT_SQL} SELECT pixel_id, time, event_id, {rnd('y', 'target_q1', digits)}, "
        f"{rnd(f'least(greatest(my + {value}, 0), 1)', 'y_pred', digits)} FROM z, c WHERE split = 'test'"
    )


def _shrunk(l1: float, l2: float) -> str:
    return f"a * sign(ay) * greatest(abs(ay) / n - {l1}, 0) / (aa / n + {l2})"


query(
    "ridge_two_features",
    _fit_sql("(a * ((b2 + 1) * ay - ab * bb) + b * ((aa + 1) * bb - ab * ay)) / ((aa + 1) * (b2 + 1) - ab * ab)", 6),
)(_model_query("Ridge", TWO))
query("ridge_closed_form", _fit_sql("a * ay / (aa + 50.0)", 6))(_model_query("Ridge", ONE, alpha=50.0))
query("lasso_closed_form", _fit_sql(_shrunk(0.0005, 0.0), 4))(_model_query("Lasso", ONE, 4, alpha=0.0005))
query("elastic_net_closed_form", _fit_sql(_shrunk(0.0005, 0.0005), 4))(_model_query("ElasticNet", ONE, 4, alpha=0.001))
query(
    "extra_tree_stump",
    f"{FIT_SQL}, g AS (SELECT min(a) + {extra_draw(42, 0, 0)!r} * (max(a) - min(a)) AS ca, min(b) + {extra_draw(42, 0, 1)!r} * (max(b) - min(b)) AS cb FROM z WHERE split = 'train'), "
    "h AS (SELECT avg(y) FILTER (WHERE a <= ca) AS al, avg(y) FILTER (WHERE a > ca) AS ar, avg(y) FILTER (WHERE b <= cb) AS bl, avg(y) FILTER (WHERE b > cb) AS br, "
    "count(*) FILTER (WHERE a <= ca) AS na, count(*) FILTER (WHERE b <= cb) AS nb, count(*) AS nn FROM z, g WHERE split = 'train') "
    f"SELECT pixel_id, time, event_id, {rnd('y', 'target_q1')}, "
    f"{rnd('CASE WHEN na * al ** 2 + (nn - na) * ar ** 2 >= nb * bl ** 2 + (nn - nb) * br ** 2 THEN CASE WHEN a <= ca THEN al ELSE ar END ELSE CASE WHEN b <= cb THEN bl ELSE br END END', 'y_pred')} "
    "FROM z, g, h WHERE split = 'test'",
)(_model_query("ExtraTree", TWO, max_depth=1))
query("pls_closed_form", _fit_sql("(a * ay + b * bb) * (ay * ay + bb * bb) / (ay * ay * aa + 2 * ay * bb * ab + bb * bb * b2)", 6))(
    _model_query("PLSRegression", TWO, n_components=1)
)


KNN_FEATURES = ["lag_0_tp", "lag_1_tp", "lag_0_t2m"]


def _knn_rows(spark, sf):
    e = src.event_series(spark, sf)
    cfg = FeatureConfig(bands=BANDS, include_rolling=False, include_spatial_coords=False, include_temporal=False)
    df, _ = targets.features_and_targets(e, 2, cfg, (1,), clim.climatology(e, "tp"), keys=src.EVENT_KEYS)
    return pin(splits.fixed_split(df.dropna(subset=["target_q1"]), src.EVENT_SPLIT))


@query(
    "knn",
    f"WITH {E}, {thr('e')}, w AS (SELECT {E_IDS}, tp AS a, lag(tp) OVER ({KE}) AS b, t2m AS c, lead(tp) OVER ({KE}) AS nx FROM e), "
    f"k AS (SELECT w.*, {sql_sigmoid('nx')} AS y, {EVENT_SPLIT_SQL} AS split FROM w LEFT JOIN thr USING (pixel_id) WHERE nx IS NOT NULL AND b IS NOT NULL), "
    "d AS (SELECT q.event_id AS qid, t.event_id AS tid, t.y, sqrt((q.a - t.a) ** 2 + (q.b - t.b) ** 2 + (q.c - t.c) ** 2) AS dist FROM k q, k t WHERE q.split = 'test' AND t.split = 'train'), "
    "n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, tid) <= 10) "
    f"SELECT qid AS event_id, {rnd('coalesce(avg(y) FILTER (WHERE dist = 0), sum(y / nullif(dist, 0)) / sum(1 / nullif(dist, 0)))', 'y_pred')} FROM n GROUP BY 1",
)
def knn(spark, sf):
    df = _knn_rows(spark, sf)
    out = knn_predict(df.filter("split = 'train'"), df.filter("split = 'test'"), KNN_FEATURES, "event_id", "event_id", "target_q1")
    return tidy(out)


@query(
    "knn_index",
    f"WITH {E}, {thr('e')}, w AS (SELECT {E_IDS}, tp AS a, lag(tp) OVER ({KE}) AS b, t2m AS c, lead(tp) OVER ({KE}) AS nx FROM e), "
    f"k AS (SELECT w.*, {sql_sigmoid('nx')} AS y, {EVENT_SPLIT_SQL} AS split FROM w LEFT JOIN thr USING (pixel_id) WHERE nx IS NOT NULL AND b IS NOT NULL), "
    "d AS (SELECT q.event_id AS qid, t.event_id AS tid, t.y, abs(q.a - t.a) + abs(q.b - t.b) + abs(q.c - t.c) AS dist FROM k q, k t WHERE q.split = 'test' AND t.split = 'train'), "
    "n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, tid) <= 5) "
    f"SELECT qid AS event_id, {rnd('coalesce(avg(y) FILTER (WHERE dist = 0), sum(y / nullif(dist, 0)) / sum(1 / nullif(dist, 0)))', 'y_pred')} FROM n GROUP BY 1",
)
def knn_index(spark, sf):
    df = _knn_rows(spark, sf)
    index = build_index(df.filter("split = 'train'"), KNN_FEATURES, "event_id", "target_q1", 5, p=1)
    out = indexed_predictions(index, df.filter("split = 'test'"), KNN_FEATURES, 5, "distance", "y_pred")
    return tidy(out.select("event_id", "y_pred"))


SEARCH_TRIALS = 30
_DRAWS = random.Random(42)
SEARCH_ALPHAS = [draw(SEARCH_SPACES["Ridge"], _DRAWS)["alpha"] for _ in range(SEARCH_TRIALS)]
SEARCH_SQL = (
    f"WITH {CHECK_CTE}, r AS (SELECT time, lag_0_tp AS a, lag_1_tp AS b, y FROM k WHERE split = 'train'), "
    "x AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM (SELECT DISTINCT time FROM r)), "
    "f AS (SELECT CAST(g.k AS INT) AS fold, g.k * fs AS te, g.k * fs + 5 AS vs, least(g.k * fs + 5 + fs, n) AS ve "
    "FROM (SELECT count(*) AS n, greatest(1, count(*) // 4) AS fs FROM x), generate_series(1, 3) g(k)), "
    "fw AS (SELECT fold, i < te AS train, r.* FROM r JOIN x ON x.time = r.time JOIN f ON i < te OR i >= vs AND i < ve), "
    "m AS (SELECT fold, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM fw WHERE train GROUP BY 1), "
    "s AS (SELECT fold, any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my, sum((a - ma) ** 2) AS aa, sum((b - mb) ** 2) AS bb, "
    "sum((a - ma) * (b - mb)) AS ab, sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS ry FROM fw JOIN m USING (fold) WHERE train GROUP BY 1), "
    "t(trial, alpha) AS (VALUES " + ", ".join(f"({i}, {a!r})" for i, a in enumerate(SEARCH_ALPHAS)) + "), "
    "c AS (SELECT fold, trial, ma, mb, my, ((bb + alpha) * ay - ab * ry) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wa, "
    "((aa + alpha) * ry - ab * ay) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wb FROM s, t) "
    f"SELECT CAST(trial AS INT) AS trial, fold, {rnd('sqrt(avg((y - least(greatest(my + wa * (a - ma) + wb * (b - mb), 0), 1)) ** 2))', 'rmse')} "
    "FROM fw JOIN c USING (fold) WHERE NOT train GROUP BY 1, 2"
)


@query("search_ridge", SEARCH_SQL)
def search_ridge(spark, sf):
    """Every trial of a ridge search on every purged fold of the training rows, in two passes over them."""
    df, _ = model_table(spark, sf)
    train = pin(df.filter("split = 'train'").select("time", *TWO, "target_q1"))
    folds = splits.purged_folds(train, 3, gap=5)
    known = fold_moments(train, folds, TWO, "target_q1")
    solved = {k: solve("Ridge", m, [{"alpha": a} for a in SEARCH_ALPHAS]) for k, m in known.items()}
    weights = {k: (np.array([w for w, _ in s]), np.array([b for _, b in s])) for k, s in solved.items()}
    out = score_trials(train, folds, TWO, "target_q1", "time", "rmse", weights)
    return tidy(out.select("trial", "fold", F.col("value").alias("rmse")))


WALK_ALPHAS = (0.1, 10.0)
WALK_SQL = (
    f"WITH {CHECK_CTE}, x AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i FROM (SELECT DISTINCT time FROM k)), "
    "c AS (SELECT count(*) AS n, greatest(count(*) // 3, 1) AS tw FROM x WHERE time <= TIMESTAMP '2024-01-25'), "
    "f AS (SELECT CAST(g.s // 5 + 1 AS INT) AS fold, CASE WHEN {growing} THEN 0 ELSE g.s END AS a, g.s + tw AS b FROM c, generate_series(0, n - tw - 40, 5) g(s)), "
    "fw AS (SELECT fold, i < b AS train, lag_0_tp AS a, lag_1_tp AS b, y FROM k JOIN x ON x.time = k.time JOIN f ON i >= f.a AND i < f.b + 40), "
    "m AS (SELECT fold, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM fw WHERE train GROUP BY 1), "
    "s AS (SELECT fold, any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my, sum((a - ma) ** 2) AS aa, sum((b - mb) ** 2) AS bb, "
    "sum((a - ma) * (b - mb)) AS ab, sum((a - ma) * (y - my)) AS ay, sum((b - mb) * (y - my)) AS ry FROM fw JOIN m USING (fold) WHERE train GROUP BY 1), "
    "t(trial, alpha) AS (VALUES " + ", ".join(f"({i}, {a!r})" for i, a in enumerate(WALK_ALPHAS)) + "), "
    "w2 AS (SELECT fold, trial, ma, mb, my, ((bb + alpha) * ay - ab * ry) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wa, "
    "((aa + alpha) * ry - ab * ay) / ((aa + alpha) * (bb + alpha) - ab * ab) AS wb FROM s, t), "
    "p AS (SELECT fold, trial, y, least(greatest(my + wa * (a - ma) + wb * (b - mb), 0), 1) AS p FROM fw JOIN w2 USING (fold) WHERE NOT train) "
    f"SELECT fold, CAST(trial AS INT) AS trial, count(*) AS n, {rnd('sqrt(avg((y - p) ** 2))', 'rmse')}, {rnd('avg(abs(y - p))', 'mae')} FROM p GROUP BY 1, 2"
)


def _walk(strategy: SplitStrategy) -> Query:
    def run(spark, sf):
        df, _ = model_table(spark, sf)
        cfg = SplitConfig(strategy=strategy, train_end="2024-01-20", val_end="2024-01-25", window_val_size=40, step_size=5)
        return tidy(walk_forward(pin(df.select("time", *TWO, "target_q1")), TWO, "target_q1", cfg, WALK_ALPHAS, ("rmse", "mae")))

    return run


query("walk_forward_grid", WALK_SQL.replace("{growing}", "FALSE"))(_walk(SplitStrategy.ROLLING))
query("walk_forward_expanding", WALK_SQL.replace("{growing}", "TRUE"))(_walk(SplitStrategy.EXPANDING))


@query("experiment_grid")
def experiment_grid(spark, sf):
    """The whole job on the event series: base table, checks, scaling, fits, calibration, report."""
    from freshet.operators.models import get_model
    from freshet.plans.experiment import ExperimentRunner

    e = src.event_series(spark, sf)
    cfg = PipelineConfig(
        p_values=(3, 6), q_values=(1,), split_config=src.EVENT_SPLIT,
        feature_config=FeatureConfig(bands=BANDS, rolling_windows=(3,), rolling_stats=("mean",)),
    )
    runner = ExperimentRunner(cfg, models=[get_model(m) for m in ("DummyMean", "Ridge", "DecisionTree")], keys=src.EVENT_KEYS)
    return tidy(runner.run(e, clim.climatology(e, "tp")).drop("elapsed_s"))


@query("legacy_grid")
def legacy_grid(spark, sf):
    """The lag-only workflow on the daily series: every pair of lookback and horizon, all rounds until they no longer help."""
    from freshet.plans.legacy import feature_target_table, grid_search

    d = src.daily_series(spark, sf).drop("t2m")
    base = feature_target_table(d, clim.climatology(d, "tp", levels={"p95": 0.95}), (3, 6), (1, 3), value="tp", slope=0.05)
    return tidy(grid_search(pin(base), (3, 6), (1, 3), src.DAY_SPLIT))
