"""Hyper-parameter search: seeded random draws scored on purged temporal folds.

Linear models are searched without fitting: one pass gives the moments of every stretch of time between fold
bounds, each fold's training moments are merged from its stretches, all trials are solved on the driver, and a
second pass scores the validation rows of all folds by all trials. Other models are fitted per trial and fold.
"""

from __future__ import annotations

import datetime as dt
import json
import logging
import math
import random
import time as clock
from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.functions.scores import clip
from freshet.operators.gramian import Moments, MomentTree, moment_table
from freshet.operators.metrics import SCALARS, evaluate, scalar_metrics
from freshet.operators.models import PRED, fit_model, get_model, solve
from freshet.operators.ordering import bucket_of
from freshet.operators.splits import Fold, assign_folds, instant, purged_folds
from freshet.runtime import in_parallel

log = logging.getLogger(__name__)

# Search ranges by model.
SEARCH_SPACES: dict[str, dict[str, tuple]] = {
    "Ridge": {"alpha": ("log_float", 1e-4, 100.0)},
    "Lasso": {"alpha": ("log_float", 1e-5, 1.0)},
    "ElasticNet": {"alpha": ("log_float", 1e-5, 1.0), "l1_ratio": ("float", 0.05, 0.95)},
    "BayesianRidge": {},
    "DecisionTree": {"max_depth": ("int", 4, 24), "min_samples_leaf": ("int", 2, 50)},
    "RandomForest": {
        "n_estimators": ("int", 100, 500),
        "max_depth": ("int", 6, 24),
        "min_samples_leaf": ("int", 2, 30),
        "max_features": ("categorical", ["sqrt", "log2", 0.5, 0.8]),
    },
    "GradientBoosting": {
        "n_estimators": ("int", 100, 500),
        "learning_rate": ("log_float", 0.01, 0.3),
        "max_depth": ("int", 3, 10),
        "subsample": ("float", 0.6, 1.0),
        "min_samples_leaf": ("int", 2, 30),
    },
    "KNN": {
        "n_neighbors": ("int", 3, 50),
        "weights": ("categorical", ["uniform", "distance"]),
        "p": ("int", 1, 2),
    },
}


def draw(space: dict[str, tuple], rng: random.Random) -> dict[str, Any]:
    """One point of the space."""
    out: dict[str, Any] = {}
    for name, (kind, *spec) in space.items():
        if kind == "int":
            out[name] = rng.randint(*spec)
        elif kind == "float":
            out[name] = rng.uniform(*spec)
        elif kind == "log_float":
            out[name] = math.exp(rng.uniform(math.log(spec[0]), math.log(spec[1])))
        elif kind == "categorical":
            out[name] = rng.choice(spec[0])
        else:
            raise ValueError(f"unknown parameter kind {kind!r}")
    return out


#: Models whose every trial follows from moments.
LINEAR = ("Ridge", "Lasso", "ElasticNet", "BayesianRidge")


@dataclass(frozen=True)
class SearchResult:
    best_params: dict[str, Any]
    trials: DataFrame | None


def _fold_score(model: str, train: DataFrame, fold: Fold, features, label, params, metric, time, seed) -> float:
    t = F.col(time)
    inside = train.filter(t.between(instant(fold.train_lo), instant(fold.train_hi)))
    held = train.filter(t.between(instant(fold.val_lo), instant(fold.val_hi)))
    fitted = fit_model(model, inside, features, label, seed, **params)
    scored = fitted.predict(held, PRED).withColumn(PRED, clip(PRED))
    # Only the metric that is asked for: ranking metrics cost two more shuffles.
    table = scalar_metrics(scored, label, PRED, names=(metric,)) if metric in SCALARS else evaluate(scored, label, PRED)
    return float(table.first()[metric])


def fold_moments(train: DataFrame, folds: Sequence[Fold], features: Sequence[str], label: str, time: str = "time") -> dict[int, Moments]:
    """Moments of each fold's training rows, all from one pass.

    The training bounds of all folds cut time into stretches, so a fold's training rows are a run of stretches,
    and a tree over the stretches gives any run by a few merges. Folds without a complete training row are absent.
    """
    before = lambda f: _moment(f.train_lo) - dt.timedelta(microseconds=1)
    cuts = sorted({c for f in folds for c in (before(f), _moment(f.train_hi))})
    stretch = bucket_of(F.col(time), F.array(*[instant(c) for c in cuts]), len(cuts))
    inside = train.select(time, *features, label).withColumn("_stretch", stretch).where(F.col("_stretch").between(1, len(cuts) - 1))
    tree = MomentTree(moment_table(inside, features, label, F.col("_stretch")), len(cuts))
    found = {f.fold: tree.run(cuts.index(before(f)) + 1, cuts.index(_moment(f.train_hi))) for f in folds}
    return {k: m.split() for k, m in found.items() if m is not None}


def _moment(value) -> dt.datetime:
    return value if isinstance(value, dt.datetime) else dt.datetime(value.year, value.month, value.day)


def score_trials(
    train: DataFrame, folds: Sequence[Fold], features: Sequence[str], label: str, time: str, metric: str, weights: dict[int, tuple[np.ndarray, np.ndarray]],
) -> DataFrame:
    """(fold, trial, value): the metric of every trial on the validation rows of every fold, in one pass.

    ``weights`` holds per fold the matrix (trials × features) and the intercepts.
    """
    held = assign_folds(train.select(time, *features, label), folds, time).where("role = 'val'")

    @F.pandas_udf("array<double>")
    def predict(fold: pd.Series, columns: pd.DataFrame) -> pd.Series:
        x, out = columns.to_numpy(dtype=float), [None] * len(fold)
        for f in fold.unique():
            at = np.flatnonzero(fold.to_numpy() == f)
            w, b = weights[int(f)]
            for i, row in zip(at, np.clip(x[at] @ w.T + b, 0.0, 1.0)):
                out[i] = row
        return pd.Series(out)

    mine = held.where(F.col("fold").isin(sorted(weights)))
    scored = mine.select("fold", F.col(label).alias("_y"), predict("fold", F.struct(*[F.col(c).cast("double") for c in features])).alias("_p"))
    each = scored.select("fold", "_y", F.posexplode("_p").alias("trial", PRED))
    by = ("fold", "trial")
    table = scalar_metrics(each, "_y", PRED, names=(metric,), by=by) if metric in SCALARS else evaluate(each, "_y", PRED, by=by)
    return table.select("fold", "trial", F.col(metric).cast("double").alias("value"))


def _linear_trials(model, train, folds, features, label, metric, time, draws: list[dict[str, Any]]) -> list[tuple[int, int, float]]:
    """(trial, fold, value) of all draws on all folds in two passes."""
    params = [{**get_model(model).params, **d} for d in draws]
    known = fold_moments(train, folds, features, label, time)
    if not known:
        raise ValueError("no fold has complete training rows")
    weights = {}
    for fold, m in known.items():
        solved = solve(model, m, params)
        weights[fold] = np.array([w for w, _ in solved]), np.array([b for _, b in solved])
    table = score_trials(train, folds, features, label, time, metric, weights)
    return [(r["trial"], r["fold"], r["value"]) for r in table.collect()]


def search(
    model: str,
    train: DataFrame,
    features: Sequence[str],
    label: str,
    metric: str = "brier",
    direction: str = "minimize",
    n_trials: int = 30,
    n_folds: int = 3,
    gap: int = 0,
    timeout: float | None = None,
    seed: int = 42,
    space: dict[str, tuple] | None = None,
    time: str = "time",
    folds: Sequence[Fold] | None = None,
) -> SearchResult:
    """Best parameters by mean fold metric; a failing trial ranks last and never wins.

    ``timeout`` makes the outcome depend on the machine's speed and is off unless asked for.

    ``train`` should be materialised by the caller: every trial reads it again. Without folds or
    without parameters to draw, the defaults stand.
    """
    space = SEARCH_SPACES.get(model, {}) if space is None else space
    folds = purged_folds(train, n_folds, gap, time=time) if folds is None else folds
    if not space or not folds:
        log.warning("no search for %s: %s", model, "no parameters" if not space else "no folds")
        return SearchResult({}, None)
    worst = math.inf if direction == "minimize" else -math.inf
    rng = random.Random(seed)
    rows, started = [], clock.monotonic()

    def attempt(fold: Fold, params: dict[str, Any]) -> float:
        try:
            return _fold_score(model, train, fold, features, label, params, metric, time, seed)
        except Exception as exc:  # noqa: BLE001 - a failed trial must not end the search
            log.warning("trial %s failed: %s", params, exc)
            return worst

    if model in LINEAR:
        draws = [draw(space, rng) for _ in range(n_trials)]
        values = {(t, f): v for t, f, v in _linear_trials(model, train, folds, features, label, metric, time, draws)}
        for trial, params in enumerate(draws):
            for fold in folds:
                value = values.get((trial, fold.fold))
                rows.append((trial, json.dumps(params), fold.fold, worst if value is None else value))
    else:
        for trial in range(n_trials):
            if timeout is not None and rows and clock.monotonic() - started > timeout:
                break
            params = draw(space, rng)
            for fold, value in zip(folds, in_parallel([partial(attempt, f, params) for f in folds], len(folds))):
                rows.append((trial, json.dumps(params), fold.fold, value))
    trials = train.sparkSession.createDataFrame(rows, "trial int, params string, fold int, value double")
    mean = trials.groupBy("trial", "params").agg(F.avg("value").alias("score"))
    order = F.asc("score") if direction == "minimize" else F.desc("score")
    finite = F.abs("score") < F.lit(math.inf)
    best = mean.filter(~F.isnan("score") & finite).orderBy(order, "trial").first()
    if best is None:
        log.warning("all trials of %s failed; the defaults stand", model)
    return SearchResult(json.loads(best["params"]) if best else {}, mean)
