import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators import alerts, metrics
from tests.conftest import ntz


def frame(spark, y, p, **more):
    return ntz(spark, pd.DataFrame({"y_true": np.asarray(y, float), "y_pred": np.asarray(p, float), **more}))


def noisy(n=100, seed=42):
    rng = np.random.default_rng(seed)
    y = np.concatenate([rng.uniform(0, 0.3, n * 8 // 10), rng.uniform(0.6, 1, n - n * 8 // 10)])
    return y, np.clip(y + rng.normal(0, 0.25, n), 0, 1).round(2)


def brute_ranking(y, p, cut=0.5):
    e = y > cut
    pos, neg = p[e], p[~e]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap, seen = 0.0, 0.0
    for s in sorted(set(p), reverse=True):
        hit = p >= s
        recall = (hit & e).sum() / e.sum()
        ap += (recall - seen) * (hit & e).sum() / hit.sum()
        seen = recall
    return auc, ap


def test_perfect(spark):
    m = metrics.evaluate(frame(spark, [0, 0, 1, 1], [0, 0, 1, 1])).first()
    assert m.rmse == m.brier == m.smape == m.fpr == 0 and m.accuracy == m.f1 == m.r2 == m.auc_roc == m.pr_auc == 1


def test_against_brute_force(spark):
    y, p = noisy(200)
    m = metrics.evaluate(frame(spark, y, p)).first()
    e, h = y > 0.5, p > 0.5
    q = np.clip(p, 1e-7, 1 - 1e-7)
    auc, ap = brute_ranking(y, p)
    want = {
        "brier": np.mean((e - p) ** 2), "rmse": np.sqrt(np.mean((y - p) ** 2)), "mae": np.mean(abs(y - p)),
        "r2": 1 - np.sum((y - p) ** 2) / np.sum((y - y.mean()) ** 2), "smape": 200 * np.mean(abs(y - p) / (y + p)),
        "accuracy": np.mean(e == h), "precision": (e & h).sum() / h.sum(), "recall": (e & h).sum() / e.sum(),
        "f1": 2 * (e & h).sum() / (h.sum() + e.sum()), "log_loss": -np.mean(np.where(e, np.log(q), np.log(1 - q))),
        "fpr": (~e & h).sum() / (~e).sum(), "auc_roc": auc, "pr_auc": ap,
    }
    assert {k: m[k] for k in want} == pytest.approx(want)


def test_degenerate(spark):
    m = metrics.evaluate(frame(spark, [0, 0, 0], [0.1, 0.7, 0.2])).first()
    assert m.auc_roc is None and m.pr_auc is None and m.recall == 0 and m.r2 == 0
    zeros = metrics.evaluate(frame(spark, [0, 0], [0, 0])).first()
    assert zeros.r2 == 1 and zeros.smape == 0


def test_predictions_are_clipped(spark):
    m = metrics.scalar_metrics(frame(spark, [0, 1], [-3, 7]), names=("mae", "log_loss")).first()
    assert m.mae == 0 and m.log_loss == pytest.approx(1e-7, rel=1e-3)


def test_grouped_equals_separate(spark):
    y, p = noisy(90, 1)
    df = frame(spark, y, p, g=np.arange(90) % 3)
    got = {r.g: r for r in metrics.evaluate(df, by=("g",)).collect()}
    for g in range(3):
        alone = metrics.evaluate(df.filter(F.col("g") == g)).first().asDict()
        assert {k: got[g][k] for k in alone} == pytest.approx(alone)


def scan(y, p, score):
    e, best, at = y > 0.5, -2.0, 0.5
    for t in np.linspace(0.01, 0.99, 200):
        h = p > t
        tp, fp, fn, tn = (e & h).sum(), (~e & h).sum(), (e & ~h).sum(), (~e & ~h).sum()
        s = score(tp, fp, fn, tn)
        if s > best:
            best, at = s, float(t)
    return at, best


F1 = lambda tp, fp, fn, tn: 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0
J = lambda tp, fp, fn, tn: tp / max(tp + fn, 1) + tn / max(tn + fp, 1) - 1


@pytest.mark.parametrize("method, score", [("f1", F1), ("youden", J)])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_pass_calibration_equals_scanning(spark, method, score, seed):
    y, p = noisy(150, seed)
    row = alerts.calibrate(frame(spark, y, p), method).first()
    assert (row.threshold, row.score) == pytest.approx(scan(y, p, score), abs=1e-12)


def test_curve_calibration(spark):
    y, p = noisy(150, 5)
    e = y > 0.5
    best = max(sorted(set(p)), key=lambda s: (F1((e & (p >= s)).sum(), (~e & (p >= s)).sum(), (e & (p < s)).sum(), 0), -s))
    assert alerts.best_threshold(frame(spark, y, p), "pr_auc") == best


@pytest.mark.parametrize("method", alerts.METHODS)
def test_grouped_calibration(spark, method):
    y, p = noisy(120, 8)
    df = frame(spark, y, p, g=np.arange(120) % 2).unionByName(frame(spark, [0.0, 0.1], [0.3, 0.4], g=[9, 9]))
    got = {r.g: r.threshold for r in alerts.calibrate(df, method, by=("g",)).collect()}
    assert got[9] == 0.5
    for g in (0, 1):
        assert got[g] == alerts.best_threshold(df.filter(F.col("g") == g), method)


@pytest.mark.parametrize("method", alerts.METHODS)
def test_one_class_gives_half(spark, method):
    rng = np.random.default_rng(0)
    assert alerts.best_threshold(frame(spark, np.zeros(50), rng.uniform(0, 0.3, 50)), method) == 0.5
    assert alerts.best_threshold(frame(spark, np.ones(5), rng.uniform(0, 1, 5)), method) == 0.5


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        alerts.calibrate(frame(spark, [0, 1], [0, 1]), "auc")


def test_labels_are_strict(spark):
    df = alerts.classify(frame(spark, [0] * 4, [0.1, 0.4, 0.5, 0.9]), 0.4)
    assert [r.alert for r in df.collect()] == [0, 0, 1, 1]


def test_report(spark):
    rng = np.random.default_rng(3)
    y, p = rng.uniform(0, 1, 200), rng.uniform(0, 1, 200)
    y[:20], y[20:30] = 0.0, 1.0
    t = pd.date_range("2023-01-01", periods=200, freq="D")
    r = alerts.anomaly_report(frame(spark, y, p, time=t), 0.4).to_dict()
    assert sum(r["confusion_matrix"].values()) == 200 == sum(b["count"] for b in r["by_intensity"].values())
    assert r["by_intensity"]["below_p90"]["count"] == 20 and set(r["by_season"]) == {"DJF_wet", "MAM_trans", "JJA_dry"}
    d = pd.Series(y - p)
    want = {"mean": d.mean(), "std": d.std(ddof=0), "skewness": d.skew(), "kurtosis": d.kurtosis()}
    want |= {f"q{int(q * 100):02d}": d.quantile(q) for q in (0.05, 0.25, 0.5, 0.75, 0.95)}
    assert r["residuals"] == pytest.approx(want)
    assert r["overall"]["threshold"] == 0.4 and r["overall"]["fnr"] == pytest.approx(1 - r["overall"]["recall"])
    without_time = alerts.anomaly_report(frame(spark, y, p), 0.4, time=None).to_dict()
    assert "by_season" not in without_time


def test_residuals_of_three(spark):
    r = alerts.residual_profile(frame(spark, [0.5] * 3, [0.4, 0.5, 0.6])).first()
    assert r.mean == pytest.approx(0) and r.q50 == pytest.approx(0) and r.kurtosis is None


def test_flat_residuals(spark):
    r = alerts.residual_profile(frame(spark, [0.5] * 6, [0.25] * 6)).first()
    assert (r.mean, r.std, r.skewness, r.kurtosis, r.q95) == (0.25, 0, 0, 0, 0.25)
