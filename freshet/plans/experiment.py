"""The experiment grid: one base table, then every (lookback, horizon, model).

The base table holds features for the longest lookback and targets for all horizons. It is
written once; each experiment reads only its own columns from it.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time as clock
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import partial
from itertools import product
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from freshet.config import FeatureConfig, FuzzyConfig, PipelineConfig, SampleMode, SeriesKeys, SplitStrategy, TARGET_BAND
from freshet.operators import quality
from freshet.operators.climatology import climatology, instant
from freshet.operators.alerts import DEFAULT_THRESHOLD, calibrate, grouped_reports, report_documents
from freshet.operators.features import FeatureMeta, FeatureSpec, present_bands, region_aggregate, select_for_lookback
from freshet.operators.metrics import evaluate
from freshet.operators.models import ModelEntry, SparkModel, fit_model, model_registry, score
from freshet.operators.ordering import ordered_view
from freshet.operators.sampling import hash_sample
from freshet.operators.scaling import fit_scaler
from freshet.operators.search import SEARCH_SPACES, search
from freshet.operators.splits import fixed_split, make_splits, test_rows
from freshet.operators.targets import _score_futures, features_and_targets
from freshet.runtime import in_parallel, pin, scratch_folder, temporary, unpin
from freshet.sources.tiles import pixel_series
from freshet.sources.sinks import cache_path, cached, content_key, ensure_thresholds, overwrite_partitions, run_record, write_json, write_summary

log = logging.getLogger(__name__)
BASE_PARTS = ("p_values", "q_values", "feature_config", "fuzzy_config", "sample_frac", "random_seed")
#: What tells runs apart; predictions are partitioned by it. Fold 0 is the only one of a fixed split.
RUN = ("experiment", "model", "fold")
ALERT_COLUMNS = ("precision", "recall", "f1", "pr_auc", "fpr")


@dataclass(frozen=True)
class RegionRun:
    """A run of region samples, restated as a run of one series per region."""

    series: DataFrame
    cfg: PipelineConfig
    keys: SeriesKeys
    band: str


def region_run(
    series: DataFrame, cfg: PipelineConfig, region_col: str, keys: SeriesKeys = SeriesKeys(), band: str = TARGET_BAND, stat: str = "mean",
) -> RegionRun:
    """Statistics of the bands per (region, time) are the bands of the new series; ``{band}_{stat}`` is forecast.

    Rows without a region or time are left out. A region row has no pixel position, so that and the calendar are
    no features. Thresholds are those of the regions: ``climatology(run.series, run.band, region_col)``.
    """
    if region_col not in series.columns:
        raise ValueError(f"no region column {region_col!r} among {series.columns}")
    features = cfg.feature_config
    stats = tuple(dict.fromkeys([*features.region_stats, stat]))
    bands = list(dict.fromkeys([band, *present_bands(series, features)]))
    own = replace(
        features, bands=tuple(f"{b}_{s}" for b in bands for s in stats), include_spatial_coords=False, include_temporal=False
    )
    return RegionRun(
        region_aggregate(series, bands, region_col, keys.time, stats), replace(cfg, sample_mode=SampleMode.PIXEL, feature_config=own),
        SeriesKeys(entity=region_col, time=keys.time), f"{band}_{stat}",
    )


def base_table(
    series: DataFrame, thresholds: DataFrame, cfg: PipelineConfig, keys: SeriesKeys = SeriesKeys(),
    band: str = TARGET_BAND, output_dir: str | None = None, verify: Callable[[DataFrame, FeatureMeta], None] | None = None,
) -> tuple[DataFrame, FeatureMeta]:
    """Features for the longest lookback and all targets; written and read back when a folder is given.

    The stored table is keyed by the configuration, the keys, the band and the rows it was made from.
    ``verify`` sees the whole table, before any sampling.
    """
    if cfg.sample_mode != SampleMode.PIXEL:
        raise ValueError(f"rows of a {cfg.sample_mode.value} run: restate it by region_run, or build patches with their own operators")
    df, meta = features_and_targets(
        series, max(cfg.p_values), cfg.feature_config, cfg.q_values, thresholds, cfg.fuzzy_config, band, keys
    )
    sample = partial(hash_sample, fraction=cfg.sample_frac, keys=[keys.entity, *keys.order], seed=cfg.random_seed)
    if output_dir is None:
        if verify:
            verify(df, meta)
        return sample(df), meta
    made_from = [str(keys), band, content_key(series), content_key(thresholds)]
    path = cache_path(output_dir, f"base_table_P{max(cfg.p_values)}", cfg, *BASE_PARTS)
    path = path.replace(".parquet", f"-{hashlib.sha256(json.dumps(made_from).encode()).hexdigest()[:16]}.parquet")

    def build() -> DataFrame:
        if verify:
            verify(df, meta)
        return sample(df)

    return cached(series.sparkSession, path, build), meta


def grid_coverage(
    series: DataFrame, features: FeatureConfig, p_values: Sequence[int], q_values: Sequence[int],
    thresholds: DataFrame, keys: SeriesKeys = SeriesKeys(), band: str = TARGET_BAND,
) -> DataFrame:
    """Usable rows and mean target of each (P, Q), counted together in one aggregate.

    A row is usable for P when its P-1 predecessors exist, hence when the oldest lag does.
    """
    bands = [b for b in features.bands if b in series.columns]
    view = ordered_view(series, [keys.entity], keys.order, max(p_values) - 1, max(q_values))
    w = view.window()
    oldest = {p: [F.lag(b, p - 1).over(w).alias(f"_old{p}_{b}") for b in bands] for p in p_values}
    leads = [F.lead(band, q).over(w).alias(f"_future_{q}") for q in q_values]
    df = view.join_groups(view.df.select("*", *[c for cs in oldest.values() for c in cs], *leads), thresholds)
    df = _score_futures(view.finish(df), q_values, FuzzyConfig())
    aggs, structs = [], []
    for p, q in product(p_values, q_values):
        usable = F.col(f"target_q{q}").isNotNull()
        for b in bands:
            usable = usable & F.col(f"_old{p}_{b}").isNotNull()
        aggs += [
            F.count_if(usable).alias(f"n_{p}_{q}"),
            F.avg(F.when(usable, F.col(f"target_q{q}"))).alias(f"m_{p}_{q}"),
        ]
        structs.append(
            F.struct(
                F.lit(p).alias("P"), F.lit(q).alias("Q"),
                F.col(f"n_{p}_{q}").alias("n_rows"), F.col(f"m_{p}_{q}").alias("vp_mean"),
            )
        )
    return df.agg(*aggs).select(F.explode(F.array(*structs)).alias("s")).select("s.*")


@dataclass
class RunResult:
    """Outcome of one model in one experiment."""

    row: dict[str, Any]
    predictions: DataFrame | None = None
    model: Any = None
    features: list[str] = field(default_factory=list)
    #: Anomaly report of the test rows at the calibrated threshold.
    report: dict[str, Any] | None = None

    @property
    def key(self) -> tuple:
        return tuple(self.row[c] for c in RUN)


@dataclass
class ExperimentRunner:
    """Runs the grid. A failing model or experiment is recorded and does not stop the rest."""

    cfg: PipelineConfig
    families: Sequence[str] | None = None
    models: Sequence[ModelEntry] | None = None
    scaler: str = "standard"
    keys: SeriesKeys = field(default_factory=SeriesKeys)
    skip_checks: bool = False
    save: bool = False
    parallel: int = 3
    overrides: dict[str, dict[str, Any]] = field(default_factory=dict)
    band: str = TARGET_BAND
    region_col: str | None = None
    region_stat: str = "mean"
    _scratch: str | None = field(default=None, repr=False)

    def run(self, series: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
        """Summary with one row per (P, Q, model). In region mode ``region_col`` names the series that are forecast.

        Thresholds are one row per series, or per region in region mode; by default the climatology of what is forecast.
        """
        spark = series.sparkSession
        with temporary(spark):
            if self.cfg.sample_mode != SampleMode.REGION:
                known = climatology(series, self.band, self.keys.entity) if thresholds is None else thresholds
                return self._run(series, known)
            if self.region_col is None:
                raise ValueError("region mode needs region_col")
            of = region_run(series, self.cfg, self.region_col, self.keys, self.band, self.region_stat)
            regions = pin(of.series)
            return replace(self, cfg=of.cfg, keys=of.keys, band=of.band).run(regions, thresholds)

    def _run(self, series: DataFrame, thresholds: DataFrame) -> DataFrame:
        spark = series.sparkSession
        out_dir = self.cfg.output_dir if self.save else None
        verify = None if self.skip_checks else self.check_lags
        base, meta = base_table(series, thresholds, self.cfg, self.keys, self.band, out_dir, verify)
        if not self.save:
            base = pin(base)
        results: list[RunResult] = []
        for P, Q in product(self.cfg.p_values, self.cfg.q_values):
            try:
                results += self.run_one(base, meta, P, Q)
            except Exception as exc:  # noqa: BLE001 - failures stay within their experiment
                log.warning("experiment P%d_Q%d failed: %s", P, Q, exc)
                results.append(RunResult({"experiment": f"exp_P{P}_Q{Q}", "P": P, "Q": Q, "error": str(exc)}))
        self.evaluate([r for r in results if r.predictions is not None])
        if self.save:
            for r in results:
                self._store(r, spark)
        summary = summary_frame(spark, [r.row for r in results])
        if self.save:
            write_summary(summary, self.cfg.output_dir)
        return summary

    def run_tiles(self, tiles: DataFrame | None = None, thresholds: DataFrame | None = None) -> DataFrame:
        """The grid from raster tiles: ``cube_dir`` unless given, with the configured stride and file limit.

        Thresholds come from the tiles' own climatology, kept in ``thresholds_dir`` when artefacts are saved.
        """
        spark = tiles.sparkSession if tiles is not None else SparkSession.getActiveSession()
        tiles = spark.read.parquet(self.cfg.cube_dir) if tiles is None else tiles
        bands = list(dict.fromkeys([TARGET_BAND, *self.cfg.feature_config.bands]))
        series = pin(pixel_series(tiles, bands, self.cfg.spatial_stride, self.cfg.max_files))
        if thresholds is None and self.save and self.cfg.sample_mode == SampleMode.PIXEL:
            thresholds = ensure_thresholds(series, self.cfg.thresholds_dir, TARGET_BAND, self.keys.entity)
        summary = self.run(series, thresholds)
        unpin(series)
        return summary

    def check_lags(self, whole: DataFrame, meta: FeatureMeta) -> None:
        """Recompute the lags of every series of the unsampled table."""
        if not any(s.kind == "lag" for s in meta.specs):
            return
        for r in quality.lag_integrity(whole, meta.specs, self.keys).filter("mismatches > 0").collect():
            raise quality.CheckFailed(f"{r['feature']} differs from its source in {r['mismatches']} rows")

    def run_one(self, base: DataFrame, meta: FeatureMeta, P: int, Q: int) -> list[RunResult]:
        """Fit and score all models of one (P, Q); metrics follow for all experiments together."""
        target = f"target_q{Q}"
        specs = select_for_lookback(meta.specs, P)
        features = [s.name for s in specs]
        ids = [self.keys.time, self.keys.entity, *self.keys.tie]
        block = [self.cfg.split_config.spatial_block_col] if self.cfg.split_config.spatial_block_col else []
        df = base.select(*dict.fromkeys([*ids, *block, *features, target])).dropna(subset=[*features, target])
        # The base table is on files: every job reads its own columns, nothing is held in memory.
        results: list[RunResult] = []
        for number, labelled in self._splits(df):
            try:
                results += self._run_fold(labelled, specs, target, P, Q, number)
            except Exception as exc:  # noqa: BLE001 - a fold that cannot be fitted does not stop the others
                if number == 0:
                    raise
                log.warning("P%d_Q%d, fold %d failed: %s", P, Q, number, exc)
                results.append(RunResult({"experiment": f"exp_P{P}_Q{Q}", "P": P, "Q": Q, "fold": number, "error": str(exc)}))
        return results

    def _run_fold(self, df: DataFrame, specs: list[FeatureSpec], target: str, P: int, Q: int, fold: int) -> list[RunResult]:
        """All models on one labelling of the rows."""
        features = [s.name for s in specs]
        counts = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
        if any(not counts.get(s) for s in ("train", "val", "test")):
            raise ValueError(f"P{P}_Q{Q}: an empty split in {counts}")
        if not self.skip_checks:
            checks = quality.check_battery(df, features, target, quality.split_masks(), self.keys.time)
            quality.require(checks)
            for r in quality.target_correlation(df, features, target).filter("alert").collect():
                raise quality.CheckFailed(f"{r['feature']} correlates with the target by {r['correlation']:.4f}")
        fitted = fit_scaler(df.filter("split = 'train'"), features, self.scaler)
        return in_parallel(
            [
                partial(self._fit_model, entry, df, fitted, specs, target, P, Q, fold, counts)
                for entry in self.models or model_registry(self.families)
            ],
            self.parallel,
        )

    def _splits(self, df: DataFrame) -> list[tuple[int, DataFrame]]:
        """(fold, rows labelled train, val, test) as the split configuration asks; a fixed split is fold 0.

        Walk-forward strategies give one labelling per fold, all tested on the rows after the test cut; with a block
        column, rows of the blocks whose hash falls in the last fifth are the test rows of either strategy.
        """
        cfg, time = self.cfg.split_config, self.keys.time
        if cfg.strategy == SplitStrategy.FIXED:
            labelled = [(0, fixed_split(df, cfg, time))]
        else:
            folds = make_splits(df, cfg, time)
            if not folds:
                raise ValueError("the walk-forward split has no fold; check the window sizes")
            labelled, t = [], F.col(time)
            for f in folds:
                label = F.when(t.between(instant(f.train_lo), instant(f.train_hi)), "train")
                label = label.when(t.between(instant(f.val_lo), instant(f.val_hi)), "val")
                labelled.append((f.fold, df.withColumn("split", label.when(test_rows(cfg, time), "test"))))
        if cfg.spatial_block_col:
            block = F.pmod(F.xxhash64(cfg.spatial_block_col), F.lit(5)) == 4
            inside = F.when(F.col("split") != "test", F.col("split"))
            own = F.when(block, F.when(F.col("split") == "test", "test")).otherwise(inside)
            labelled = [(number, rows.withColumn("split", own)) for number, rows in labelled]
        return labelled

    def _fit_model(self, entry, df, fitted, specs: list[FeatureSpec], target, P, Q, fold, counts) -> RunResult:
        """Tune, fit and score one model; its predictions are materialised here, failures included."""
        started = clock.monotonic()
        features = [s.name for s in specs]
        row: dict[str, Any] = {
            "experiment": f"exp_P{P}_Q{Q}", "P": P, "Q": Q, "model": entry.name, "fold": fold, "family": entry.family,
            "input_type": entry.input_type, "n_features": len(features), "tuned": False,
            **{f"{s}_rows": counts[s] for s in ("train", "val", "test")},
        }
        try:
            data = fitted.transform(df) if entry.needs_scaling else df
            train = data.filter("split = 'train'")
            if entry.name == "KNN":
                row["labelled_rows"] = counts["train"]
            params = {**self.overrides.get(entry.name, {}), **self._tuned(entry, train, features, target, row)}
            model = fit_model(entry, train, features, target, self.cfg.random_seed, **params)
            ids = [self.keys.time, self.keys.entity, *self.keys.tie]
            scored = score(model, data.filter("split != 'train'")).select(
                *ids, "split", F.col(target).cast("double").alias("y_true"), "y_pred"
            )
            result = RunResult(row, self._materialise(scored, row), model, features)
        except Exception as exc:  # noqa: BLE001 - recorded as an error row
            log.warning("model %s failed: %s", entry.name, exc)
            result = RunResult({**row, "error": str(exc)})
        result.row["elapsed_s"] = round(clock.monotonic() - started, 2)
        return result

    def _tuned(self, entry, train, features, target, row) -> dict[str, Any]:
        tuning = self.cfg.tuning_config
        if not (tuning.enabled and SEARCH_SPACES.get(entry.name)):
            return {}
        found = search(
            entry.name, train, features, target, tuning.metric, tuning.direction, tuning.n_trials,
            tuning.n_cv_folds, tuning.cv_gap, tuning.timeout_per_model, self.cfg.random_seed, time=self.keys.time,
        ).best_params
        row.update(tuned=bool(found), best_params=json.dumps(found))
        return found

    def _materialise(self, scored: DataFrame, row: dict[str, Any]) -> DataFrame:
        """The run's partition of the one table of predictions, replaced if it was there; read back pruned to it."""
        mine = scored.select("*", *[F.lit(row[c]).alias(c) for c in RUN])
        overwrite_partitions(mine, self._predictions(scored.sparkSession), RUN)
        return self.predictions(mine.sparkSession, mine.schema).filter(" and ".join(f"{c} = {row[c]!r}" for c in RUN))

    def _predictions(self, spark: SparkSession) -> str:
        if self.save:
            return f"{self.cfg.output_dir}/predictions.parquet"
        if self._scratch is None:
            self._scratch = scratch_folder(spark)
        return self._scratch

    def predictions(self, spark: SparkSession, schema: T.StructType | None = None) -> DataFrame:
        """All runs' predictions as one table, partitioned by what tells runs apart."""
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(self._predictions(spark))

    def evaluate(self, results: list[RunResult]) -> None:
        """Metrics, thresholds, alert scores and reports of all runs; the number of jobs does not depend on the runs."""
        if not results:
            return
        spark, run = results[0].predictions.sparkSession, list(RUN)
        here = spark.createDataFrame([r.key for r in results], "experiment string, model string, fold int")
        # Of a table that earlier runs have written to as well, only these partitions are read.
        everything = self.predictions(spark, results[0].predictions.schema).join(F.broadcast(here), run, "left_semi")
        of = {r.key: r for r in results}
        for m in evaluate(everything, by=(*run, "split")).collect():
            found = {f"{m['split']}_{k}": v for k, v in m.asDict().items() if k not in (*run, "split")}
            of[tuple(m[c] for c in run)].row.update(found)
        method = self.cfg.tuning_config.calibration_method
        # One threshold per run; runs without validation rows keep the default.
        levels = calibrate(everything.filter("split = 'val'"), method, by=run).select(*run, F.col("threshold").alias("_level"))
        # Read by several jobs from here on; a row per run.
        test = everything.filter("split = 'test'").join(F.broadcast(pin(levels)), run, "left")
        level = F.coalesce(F.col("_level").cast("double"), F.lit(DEFAULT_THRESHOLD))
        for key, report in report_documents(grouped_reports(test, run, level, time=self.keys.time), run).items():
            result, overall = of[key], report["overall"]
            result.report = report
            result.row["threshold"] = overall["threshold"]
            result.row.update({f"anomaly_{c}": overall[c] for c in ALERT_COLUMNS})

    def _folder(self, row: dict[str, Any]) -> str:
        fold = f"/fold_{row['fold']}" if row["fold"] else ""
        return f"{self.cfg.output_dir}/{row['experiment']}/{row['model']}{fold}"

    def _store(self, result: RunResult, spark) -> None:
        """Report, fitted model and run record beside the predictions."""
        row = result.row
        if "model" not in row:
            return
        folder = self._folder(row)
        if result.report is not None:
            write_json(spark, result.report, f"{folder}/anomaly_report")
        if isinstance(result.model, SparkModel):
            result.model.save(f"{folder}/model")
        record = run_record(self.cfg, row["P"], row["Q"], row["model"], result.features, row, spark)
        write_json(spark, record, f"{folder}/metadata")


def summary_frame(spark, rows: list[dict[str, Any]]) -> DataFrame:
    """Rows with different columns as one frame; absent values are NULL."""
    names = list(dict.fromkeys(k for r in rows for k in r))

    def kind(name: str) -> T.DataType:
        values = [r[name] for r in rows if r.get(name) is not None]
        if values and all(isinstance(v, bool) for v in values):
            return T.BooleanType()
        if values and all(isinstance(v, int) for v in values):
            return T.LongType()
        if values and all(isinstance(v, (int, float)) for v in values):
            return T.DoubleType()
        return T.StringType()

    kinds = {n: kind(n) for n in names}

    def cell(name: str, value):
        if value is None:
            return None
        return float(value) if isinstance(kinds[name], T.DoubleType) else value

    schema = T.StructType([T.StructField(n, kinds[n]) for n in names])
    return spark.createDataFrame([tuple(cell(n, r.get(n)) for n in names) for r in rows], schema)
