"""Sinks, the experiment grid and the legacy workflow."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from freshet.config import FeatureConfig, PipelineConfig, SampleMode, SplitConfig, SplitStrategy, TuningConfig
from freshet.operators import climatology as clim
from freshet.operators.models import ModelEntry, fit_model, get_model
from freshet.operators.quality import CheckFailed
from freshet.operators.sampling import exact_sample, hash_sample, sample_entities
from freshet.plans import catalogue, legacy
from freshet.plans.experiment import ExperimentRunner, base_table, grid_coverage, region_run
from freshet.plans.legacy import feature_target_table, grid_search
from freshet.runtime import pin, shared_folder
from freshet.sources import sinks

SPLIT = SplitConfig(train_end="2022-01-02", val_end="2022-01-02T12:00:00")
FEATURES = FeatureConfig(bands=("tp",), rolling_windows=(3,), rolling_stats=("mean",))


def test_formats(spark, pixels, tmp_path):
    p = sinks.save_table(pixels, str(tmp_path / "a"))
    assert p.endswith(".parquet") and spark.read.parquet(p).count() == 150
    c = sinks.save_table(pixels.select("pixel_id", "tp"), str(tmp_path / "b"), "csv", ("pixel_id",))
    assert c.endswith(".csv") and spark.read.option("header", True).csv(c).count() == 150
    with pytest.raises(ValueError):
        sinks.save_table(pixels, str(tmp_path / "c"), "xlsx")


def test_cache_is_keyed_by_what_made_it(spark, pixels, tmp_path):
    a, b = PipelineConfig(feature_config=FEATURES), PipelineConfig()
    assert sinks.cache_path("o", "t", a) != sinks.cache_path("o", "t", b)
    calls = []
    build = lambda: calls.append(1) or pixels
    path = str(tmp_path / "cache")
    assert sinks.cached(spark, path, build).count() == sinks.cached(spark, path, build).count() == 150 and calls == [1]
    (tmp_path / "cache" / "_SUCCESS").unlink()  # an interrupted write does not count
    sinks.cached(spark, path, build)
    assert calls == [1, 1]


def test_thresholds_are_computed_once(spark, pixels, tmp_path):
    one = sinks.ensure_thresholds(pixels, str(tmp_path), "tp").orderBy("pixel_id").collect()
    again = sinks.ensure_thresholds(pixels.orderBy("tp"), str(tmp_path), "tp").orderBy("pixel_id").collect()
    assert one == again and len(one) == 3
    assert sinks.ensure_thresholds(pixels.limit(1), str(tmp_path), "tp", force=True).count() == 1
    meta = json.loads(spark.read.text(str(tmp_path / "thresholds_meta")).first().value)
    assert meta["quantiles"]["p95"] == 0.95


def test_summary(spark, tmp_path):
    a = spark.createDataFrame([(1, 0.5)], "P int, rmse double")
    b = spark.createDataFrame([(2, "boom")], "P int, error string")
    s = sinks.append_summary(sinks.append_summary(None, a), b)
    path = sinks.write_summary(s, str(tmp_path))
    assert spark.read.option("header", True).csv(path).count() == 2 and set(s.columns) == {"P", "rmse", "error"}


def test_hashes(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert sinks.file_hashes(spark, str(tmp_path)).first().sha256 == hashlib.sha256(b"abc").hexdigest()


def test_storage_layout(spark, pixels, tmp_path):
    sinks.clustered(pixels, "pixel_id", "time", 3).write.parquet(str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 150


def test_samples(skewed):
    key = ["pixel_id", "time"]
    a, b = (hash_sample(df, 0.3, key).orderBy(*key).collect() for df in (skewed, skewed.repartition(5)))
    assert a == b and 120 < len(a) < 240
    assert exact_sample(skewed, 0.1, key).count() == 60 and hash_sample(skewed, 1.0, key) is skewed
    assert sample_entities(skewed, "pixel_id").count() == 5


def test_pinned_tables_go_to_the_shared_folder(spark, pixels):
    kept = pin(pixels)
    assert kept.exceptAll(pixels).isEmpty() and kept.count() == 150
    assert f"{shared_folder(spark)}/pinned-" in kept.inputFiles()[0] and shared_folder(spark) == shared_folder(spark)


def test_the_cluster_names_the_shared_folder():
    class Session:
        conf = {"spark.checkpoint.dir": "hdfs://shared/tmp/"}

    assert shared_folder(Session()) == "hdfs://shared/tmp"


def test_coverage(pixels):
    thr = clim.climatology(pixels, "tp")
    got = {(r.P, r.Q): r.n_rows for r in grid_coverage(pixels, FEATURES, (3, 6), (1, 3), thr).collect()}
    assert got == {(p, q): 3 * (50 - (p - 1) - q) for p in (3, 6) for q in (1, 3)}


def test_grid_with_artefacts(spark, pixels, tmp_path):
    def explode(*_):
        raise RuntimeError("no convergence")

    cfg = PipelineConfig(
        p_values=(3, 6), q_values=(1, 60), feature_config=FEATURES, split_config=SPLIT, output_dir=str(tmp_path / "out"),
        tuning_config=TuningConfig(enabled=True, n_trials=1, n_cv_folds=2, metric="rmse"),
    )
    models = [get_model("DummyMean"), get_model("Ridge"), get_model("DecisionTree"), ModelEntry("Broken", "X", explode)]
    runner = ExperimentRunner(cfg, models=models, save=True, overrides={"DecisionTree": {"max_depth": 3}})
    pixels = pixels.withColumn("pixel_id", F.explode(F.array(*[F.col("pixel_id") + 3 * i for i in range(3)])))
    rows = [r.asDict() for r in runner.run(pixels, clim.climatology(pixels, "tp")).collect()]
    by = {(r["P"], r["Q"], r["model"]): r for r in rows}
    assert len(rows) == 2 * 4 + 2 and all("split" in by[p, 60, None]["error"] for p in (3, 6))
    assert "no convergence" in by[3, 1, "Broken"]["error"] and by[3, 1, "Broken"]["test_rmse"] is None
    ok = by[3, 1, "Ridge"]
    assert ok["train_rows"] + ok["val_rows"] + ok["test_rows"] == 9 * (50 - 5 - 1) and ok["tuned"]
    assert 0 <= ok["test_brier"] <= 1 and 0 < ok["threshold"] < 1 and ok["error"] is None
    folder = tmp_path / "out" / "exp_P3_Q1" / "DecisionTree"
    assert all((folder / n).exists() for n in ("anomaly_report", "metadata", "model"))
    report = json.loads(spark.read.text(str(folder / "anomaly_report")).first().value)
    assert sum(report["confusion_matrix"].values()) == ok["test_rows"]
    assert (tmp_path / "out" / "summary_results.csv").exists()


def test_predictions_are_one_table_and_a_rerun_replaces_its_own_part(spark, pixels, tmp_path):
    cfg = PipelineConfig(p_values=(3,), q_values=(1,), feature_config=FEATURES, split_config=SPLIT, output_dir=str(tmp_path / "out"))
    thresholds = clim.climatology(pixels, "tp")

    def run(*models, **overrides):
        runner = ExperimentRunner(cfg, models=[get_model(m) for m in models], save=True, overrides=overrides)
        summary = runner.run(pixels, thresholds)
        rows = runner.predictions(spark)
        return summary.collect(), {m: rows.filter(F.col("model") == m).agg(F.count("*"), F.sum("y_pred")).first() for m in ("DummyMean", "Ridge")}

    _, first = run("DummyMean", "Ridge")
    again, second = run("Ridge", Ridge={"alpha": 1000.0})
    assert [r.model for r in again] == ["Ridge"] and again[0].val_rows + again[0].test_rows == first["Ridge"][0] == second["Ridge"][0]
    assert first["DummyMean"] == second["DummyMean"] and first["Ridge"][1] != second["Ridge"][1]
    pruned = ExperimentRunner(cfg, save=True).predictions(spark).filter("model = 'Ridge'")
    assert "PartitionFilters: [isnotnull(model" in pruned._jdf.queryExecution().explainString(pruned._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_every_fold_of_a_walk_is_evaluated(pixels):
    cut = SplitConfig(strategy=SplitStrategy.ROLLING, train_end="2022-01-02", val_end="2022-01-02T12:00:00", window_train_size=12, window_val_size=6, step_size=6)
    cfg = PipelineConfig(p_values=(3,), q_values=(1,), feature_config=FEATURES, split_config=cut)
    rows = ExperimentRunner(cfg, models=[get_model("DummyMean"), get_model("Ridge")]).run(pixels, clim.climatology(pixels, "tp")).collect()
    assert {(r.model, r.fold) for r in rows} == {(m, k) for m in ("DummyMean", "Ridge") for k in range(1, len(rows) // 2 + 1)} and len(rows) >= 6
    assert all(r.train_rows == 36 and r.val_rows == 18 and r.val_rmse > 0 and 0 < r.threshold < 1 for r in rows)


def test_damaged_lags_stop_the_run(pixels):
    cfg = PipelineConfig(p_values=(3,), q_values=(1,), feature_config=FEATURES)
    base, meta = base_table(pixels, clim.climatology(pixels, "tp"), cfg)
    runner = ExperimentRunner(cfg)
    runner.check_lags(base, meta)
    with pytest.raises(CheckFailed, match="lag_2_tp"):
        runner.check_lags(base.withColumn("lag_2_tp", F.col("lag_1_tp")), meta)


def test_sampled_base_table(pixels):
    cfg = PipelineConfig(p_values=(3,), q_values=(1,), feature_config=FEATURES, sample_frac=0.5)
    df, _ = base_table(pixels, clim.climatology(pixels, "tp"), cfg)
    whole, _ = base_table(pixels, clim.climatology(pixels, "tp"), PipelineConfig(p_values=(3,), q_values=(1,), feature_config=FEATURES))
    assert 40 < df.count() < 110 and df.exceptAll(whole).isEmpty()


def test_legacy(spark, pixels, tmp_path):
    p95 = clim.climatology(pixels.filter("pixel_id < 2"), "tp", levels={"p95": 0.95})
    series = pixels.select("pixel_id", "time", F.col("tp").alias("precipitation"))
    base = feature_target_table(series, p95, (2, 3), (1, 3))
    assert base.count() == 2 * (50 - 3 - 3) and base.select("pixel_id").distinct().count() == 2
    out = grid_search(base, (2,), (1, 3), SPLIT, str(tmp_path), n_estimators=5, max_depth=2).collect()
    assert [r.experiment for r in out] == ["exp_P2_Q1", "exp_P2_Q3"] and all(0 <= r.brier_score <= 1 and r.best_iter >= 1 for r in out)
    assert (tmp_path / "exp_P2_Q1" / "test_set.parquet").exists()
    assert grid_search(base, (2,), (1,), SplitConfig(train_end="2030-01-01", val_end="2031-01-01")).count() == 0


def test_legacy_grid_is_whole(spark, pixels, monkeypatch):
    """The registered query fits every pair with the registry's rounds and depth, and waits before it stops."""
    asked, fits = [], []
    series = pixels.select("pixel_id", "time", F.col("tp").alias("precipitation"))
    base = feature_target_table(series, clim.climatology(pixels, "tp", levels={"p95": 0.95}), (2,), (1,))
    monkeypatch.setattr(catalogue.src, "daily_series", lambda *a: pixels)
    monkeypatch.setattr(legacy, "grid_search", lambda b, p, q, split, **params: asked.append((p, q, params)) or b)
    catalogue.QUERIES["legacy_grid"](spark, "")
    assert asked == [((3, 6), (1, 3), {})]
    monkeypatch.setattr(legacy, "fit_model", lambda *a, **params: fits.append(params) or fit_model("DummyMean", *a[1:]))
    with pytest.raises(AttributeError):  # a mean has no trees
        grid_search(base, (2,), (1,), SPLIT)
    assert fits == [{"validation_col": "_held", "patience": 20}]


def test_region_samples_run_the_grid(spark, pixels, tmp_path):
    more = pixels.union(pixels.select(*[(F.col(c) + 100).alias(c) if c == "pixel_id" else (F.col(c) * 2).alias(c) if c == "tp" else F.col(c) for c in pixels.columns]))
    zones = more.withColumn("zone", F.when(F.col("pixel_id") < 100, "low").when(F.col("pixel_id") < 102, "high"))
    cfg = PipelineConfig(p_values=(2, 3), q_values=(1,), feature_config=FEATURES, split_config=SPLIT, sample_mode=SampleMode.REGION, output_dir=str(tmp_path))
    with pytest.raises(ValueError, match="region"):
        base_table(zones, clim.climatology(zones, "tp"), cfg)
    with pytest.raises(ValueError, match="region_col"):
        ExperimentRunner(cfg).run(zones)
    with pytest.raises(ValueError, match="nowhere"):
        region_run(zones, cfg, "nowhere")
    of = region_run(zones, cfg, "zone")
    base, meta = base_table(of.series, clim.climatology(of.series, of.band, "zone"), of.cfg, of.keys, of.band)
    plain = zones.dropna(subset=["zone"]).groupBy("zone", "time").agg(F.avg("tp").alias("m"), F.max("tp").alias("x")).toPandas().sort_values(["zone", "time"])
    for lag in (0, 2):
        for c in "mx":
            plain[f"{c}{lag}"] = plain.groupby("zone")[c].shift(lag)
    plain["ahead"] = plain.groupby("zone")["m"].shift(-1)
    got = base.toPandas().merge(plain, on=["zone", "time"])
    assert len(got) == base.count() and "lag_2_tp_max" in meta.names and meta.bands == of.cfg.feature_config.bands
    assert (got.lag_0_tp_mean - got.m0).abs().max() < 1e-9 and (got.lag_2_tp_max - got.x2).abs().max() < 1e-9
    level = plain.groupby("zone")["m"].quantile(0.9).to_dict()
    below = got[got.ahead <= got.zone.map(level)]
    assert len(below) > 60 and (below.target_q1 == 0).all() and got[got.ahead.isna()].target_q1.isna().all()
    rows = ExperimentRunner(cfg, models=[get_model("DummyMean"), get_model("Ridge")], region_col="zone", save=True).run(zones).collect()
    assert {(r.P, r.model) for r in rows} == {(p, m) for p in (2, 3) for m in ("DummyMean", "Ridge")}
    assert all(r.train_rows and r.val_rmse is not None for r in rows), rows
    saved = ExperimentRunner(cfg, save=True).predictions(spark)
    assert {r.zone for r in saved.select("zone").distinct().collect()} == {"low", "high"}
