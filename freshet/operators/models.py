"""Regressors behind one small interface: fit on a frame, score a frame.

Linear models are scored as a plain column expression; tree models by Spark ML. Every score is
clipped to [0, 1] on request.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.functions.scores import clip
from freshet.operators.convex import insensitive, minimise
from freshet.operators.extratree import fit_extra_tree
from freshet.operators.gramian import Moments, bayesian_ridge, moments, partial_least_squares, ridge, sparse_path
from freshet.operators.neighbour_index import NeighbourIndex, build_index, indexed_predictions
from freshet.operators.neighbours import MAX_ROWS, Reference, neighbour_column, reference_rows
from freshet.operators.quantiles import exact_percentiles, percentile_array

PRED = "y_pred"
_VEC = "_features"
#: Numbers that one partition of a tree's training rows may hold. Every level of a tree reads its rows from memory again,
#: about 12 bytes a number; a row takes as much as ``_ROW_CELLS`` numbers besides its features.
TREE_CELLS, _ROW_CELLS = 4_000_000, 20


@dataclass(frozen=True)
class ConstantModel:
    value: float

    def predict(self, df: DataFrame, out: str = PRED) -> DataFrame:
        return df.withColumn(out, F.lit(self.value))


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    link: Callable[[Column], Column] | None = None

    def predict(self, df: DataFrame, out: str = PRED) -> DataFrame:
        value = F.lit(float(self.intercept))
        for c, w in zip(self.features, self.weights):
            if w != 0.0:
                value = value + F.col(c).cast("double") * F.lit(float(w))
        return df.withColumn(out, self.link(value) if self.link else value)


@dataclass(frozen=True)
class SparkModel:
    """A fitted Spark ML model over assembled columns."""

    features: tuple[str, ...]
    model: Any

    def predict(self, df: DataFrame, out: str = PRED) -> DataFrame:
        ready = _assemble(df, self.features)
        return self.model.transform(ready).withColumnRenamed("prediction", out).drop(_VEC)

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


@dataclass(frozen=True)
class NeighbourModel:
    """Lazy learner: keeps a bounded set of labelled rows."""

    known: Reference
    features: tuple[str, ...]
    k: int
    weights: str
    p: int

    def predict(self, df: DataFrame, out: str = PRED) -> DataFrame:
        value = neighbour_column(df.sparkSession, self.known, self.features, self.k, self.weights, self.p)
        return df.withColumn(out, value)


@dataclass(frozen=True)
class IndexedNeighbourModel:
    """Lazy learner over any number of labelled rows."""

    index: NeighbourIndex | None
    features: tuple[str, ...]
    k: int
    weights: str

    def predict(self, df: DataFrame, out: str = PRED) -> DataFrame:
        return indexed_predictions(self.index, df, self.features, self.k, self.weights, out)


def _assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=_VEC, handleInvalid="error").transform(df)


def _dealt(df: DataFrame, features: Sequence[str], *others: str) -> DataFrame:
    """The columns that a tree is fitted on, assembled, in partitions that do not grow with the table.

    What fits one partition stays as it lies. More rows are dealt out evenly and sorted, so that draws of rows repeat.
    """
    slim = df.select(*dict.fromkeys([*features, *others]))
    n, most = slim.count(), max(TREE_CELLS // (len(features) + _ROW_CELLS), 1)
    if n > most:
        parts = max(-(-n // most), df.sparkSession.sparkContext.defaultParallelism)
        slim = slim.repartition(parts).sortWithinPartitions(*slim.columns)
    return _assemble(slim, features)


def fit_mean(df, features, label, params, seed):
    return ConstantModel(float(df.agg(F.avg(label)).first()[0]))


def fit_median(df, features, label, params, seed):
    return ConstantModel(float(exact_percentiles(df, [], label, {"m": 0.5}).first()["m"]))


def _linear(features: Sequence[str], solution: tuple[np.ndarray, float], link=None) -> LinearModel:
    return LinearModel(tuple(features), tuple(map(float, solution[0])), float(solution[1]), link)


def solve(name: str, m: Moments, params: Sequence[dict[str, Any]]) -> list[tuple[np.ndarray, float]]:
    """(weights, intercept) of a linear model for every parameter set, from the moments of its training rows alone."""
    if name == "Ridge":
        return [ridge(m, p["alpha"]) for p in params]
    if name == "BayesianRidge":
        return [bayesian_ridge(m, **p) for p in params]
    if name not in ("Lasso", "ElasticNet"):
        raise KeyError(f"{name} needs more than moments")
    out: dict[int, tuple[np.ndarray, float]] = {}
    kinds = {(p.get("l1_ratio", 1.0) if name == "ElasticNet" else 1.0, p["max_iter"]) for p in params}
    for ratio, sweeps in sorted(kinds):  # one path for each mixture
        mine = [i for i, p in enumerate(params) if ((p.get("l1_ratio", 1.0) if name == "ElasticNet" else 1.0), p["max_iter"]) == (ratio, sweeps)]
        out.update(zip(mine, sparse_path(m, [params[i]["alpha"] for i in mine], ratio, sweeps)))
    return [out[i] for i in range(len(params))]


def _fit_linear(name: str) -> Callable:
    def fit(df, features, label, params, seed):
        return _linear(features, solve(name, moments(df, features, label), [params])[0])

    return fit


fit_ridge, fit_lasso, fit_elastic_net, fit_bayesian_ridge = (_fit_linear(n) for n in ("Ridge", "Lasso", "ElasticNet", "BayesianRidge"))


def fit_random_cuts(df, features, label, params, seed):
    return fit_extra_tree(df, features, label, params["max_depth"], params.get("min_samples_split", 2), seed)


def fit_linear_svr(df, features, label, params, seed):
    """Support vector regression without a kernel; the intercept is penalised like a weight."""
    spread = float(df.agg(F.stddev_pop(label)).first()[0] or 0.0) or 1.0
    stages = [insensitive(params["epsilon"], spread * 10.0**-k) for k in range(1, 6)]
    return _linear(features, minimise(df, features, label, stages, params["C"], params["max_iter"]))


def fit_pls(df, features, label, params, seed):
    return _linear(features, partial_least_squares(moments(df, features, label), params["n_components"]))


def _tree_params(params: dict, seed: int) -> dict:
    out = {"seed": seed, "maxDepth": params["max_depth"]}
    if "min_samples_leaf" in params:
        out["minInstancesPerNode"] = params["min_samples_leaf"]
    return out


def fit_tree(df, features, label, params, seed):
    est = DecisionTreeRegressor(featuresCol=_VEC, labelCol=label, maxMemoryInMB=1024, **_tree_params(params, seed))
    return SparkModel(tuple(features), est.fit(_dealt(df, features, label)))


def fit_forest(df, features, label, params, seed):
    subset = params.get("max_features", "all")
    est = RandomForestRegressor(
        featuresCol=_VEC, labelCol=label, numTrees=params["n_estimators"], maxMemoryInMB=1024,
        featureSubsetStrategy=str(subset), **_tree_params(params, seed),
    )
    return SparkModel(tuple(features), est.fit(_dealt(df, features, label)))


def fit_gbt(df, features, label, params, seed):
    """Gradient boosting; rows flagged by ``validation_col`` stop it early when given.

    Spark stops at the first round that gains little. With ``patience`` it goes on until so many rounds in a row
    brought no lower squared error, and the rounds up to the lowest stay.
    """
    est = GBTRegressor(
        featuresCol=_VEC, labelCol=label, maxIter=params["n_estimators"], stepSize=params["learning_rate"],
        subsamplingRate=params["subsample"], maxMemoryInMB=1024, **_tree_params(params, seed),
    )
    flag = params.get("validation_col")
    if flag and params.get("patience"):
        fitting, held = _dealt(df.filter(~F.col(flag)), features, label), _assemble(df.filter(flag), features)
        return SparkModel(tuple(features), _patient(est, fitting, held, params["n_estimators"], params["patience"]))
    held = [flag] if flag else []
    if held:
        est = est.setValidationIndicatorCol(*held)
    return SparkModel(tuple(features), est.fit(_dealt(df, features, label, *held)))


def _patient(est: GBTRegressor, fitting: DataFrame, held: DataFrame, rounds: int, patience: int):
    """The model of the rounds up to the lowest error on ``held``, as if all ``rounds`` were at hand.

    Draws depend on the seed and the round alone, so a longer fit begins with the shorter one: rounds are doubled
    until the errors say where to stop.
    """
    n = min(rounds, 2 * patience)
    while True:
        model = est.setMaxIter(n).fit(fitting)
        best, over = best_round(model.evaluateEachIteration(held, "squared"), patience)
        if over or n == rounds:
            return model if best == n else est.setMaxIter(best).fit(fitting)
        n = min(rounds, 2 * n)


def best_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """Round (from 1) of the lowest error before ``patience`` rounds without a lower one, and whether those were seen."""
    best, lowest = 0, float("inf")
    for k, e in enumerate(errors, 1):
        if e < lowest:
            best, lowest = k, e
        elif k - best >= patience:
            return max(best, 1), True
    return best or len(errors), False


def fit_knn(df, features, label, params, seed):
    """``row_id`` names the unique columns that order equal distances; by default all columns order them.

    Up to ``max_rows`` labelled rows go to every task; more are indexed, all of them. Either way the neighbours are exact.
    """
    ids = params.get("row_id")
    if df.count() > params.get("max_rows", MAX_ROWS):
        index = build_index(df, features, ids or df.columns, label, params["n_neighbors"], params.get("p", 2))
        return IndexedNeighbourModel(index, tuple(features), params["n_neighbors"], params["weights"])
    known = reference_rows(df, features, ids or df.columns, label, params.get("max_rows", MAX_ROWS), unique=bool(ids))
    return NeighbourModel(known, tuple(features), params["n_neighbors"], params["weights"], params.get("p", 2))


def fit_transformed_ridge(df, features, label, params, seed):
    """Ridge on normal scores of the label; predictions are mapped back through the quantiles."""
    n = df.count()
    knots = min(params["n_quantiles"], n)
    refs = [i / (knots - 1) if knots > 1 else 0.5 for i in range(knots)]
    levels = percentile_array(df, [], label, refs).first()["levels"]
    values, refs = np.array(levels, dtype=float), np.array(refs)
    edge = 1e-7
    # The normal distribution on a fine grid: interpolation is exact to about 1e-8 and needs no loop over rows.
    grid = np.linspace(-5.3, 5.3, 1 << 16)
    mass = np.array([NormalDist().cdf(v) for v in grid])

    @F.pandas_udf("double")
    def to_normal(y: pd.Series) -> pd.Series:
        x = y.to_numpy(dtype=float)
        up = np.interp(x, values, refs)
        down = -np.interp(-x, -values[::-1], -refs[::-1])
        u = np.clip((up + down) / 2, edge, 1 - edge)
        return pd.Series(np.interp(u, mass, grid))

    @F.pandas_udf("double")
    def from_normal(z: pd.Series) -> pd.Series:
        return pd.Series(np.interp(np.interp(z.to_numpy(dtype=float), grid, mass), refs, values))

    scored = df.withColumn("_z", to_normal(F.col(label).cast("double")))
    base = fit_ridge(scored, features, "_z", {"alpha": params["alpha"]}, seed)
    return LinearModel(base.features, base.weights, base.intercept, from_normal)


@dataclass(frozen=True)
class ModelEntry:
    name: str
    family: str
    fit: Callable
    params: dict[str, Any] = field(default_factory=dict)
    needs_scaling: bool = True
    input_type: str = "tabular"


# Model names, family codes and default parameters.
REGISTRY: tuple[ModelEntry, ...] = (
    ModelEntry("DummyMean", "D", fit_mean),
    ModelEntry("DummyMedian", "D", fit_median),
    ModelEntry("Ridge", "L", fit_ridge, {"alpha": 1.0}),
    ModelEntry("Lasso", "L", fit_lasso, {"alpha": 0.01, "max_iter": 5000}),
    ModelEntry("ElasticNet", "L", fit_elastic_net, {"alpha": 0.01, "l1_ratio": 0.5, "max_iter": 5000}),
    ModelEntry("BayesianRidge", "L", fit_bayesian_ridge),
    ModelEntry("DecisionTree", "T", fit_tree, {"max_depth": 12}, needs_scaling=False),
    ModelEntry("ExtraTree", "T", fit_random_cuts, {"max_depth": 12}, needs_scaling=False),
    ModelEntry("RandomForest", "E", fit_forest, {"n_estimators": 300, "max_depth": 16, "min_samples_leaf": 5}, needs_scaling=False),
    ModelEntry(
        "GradientBoosting", "E", fit_gbt,
        {"n_estimators": 300, "learning_rate": 0.05, "max_depth": 6, "subsample": 0.8}, needs_scaling=False,
    ),
    ModelEntry("KNN", "N", fit_knn, {"n_neighbors": 10, "weights": "distance"}),
    ModelEntry("LinearSVR", "S", fit_linear_svr, {"C": 1.0, "epsilon": 0.0, "max_iter": 5000}),
    ModelEntry("TransformedTarget_Ridge", "C", fit_transformed_ridge, {"alpha": 1.0, "n_quantiles": 1000}),
    ModelEntry("PLSRegression", "CD", fit_pls, {"n_components": 5}),
)


def model_registry(families: Sequence[str] | None = None) -> list[ModelEntry]:
    """Entries of the given families, in registry order; unknown codes only warn."""
    if families is None:
        return list(REGISTRY)
    known = {e.family for e in REGISTRY}
    for code in families:
        if code not in known:
            warnings.warn(f"unknown model family {code}")
    return [e for code in families for e in REGISTRY if e.family == code]


def get_model(name: str) -> ModelEntry:
    for entry in REGISTRY:
        if entry.name == name:
            return entry
    raise KeyError(f"model {name!r} is not in the registry")


def fit_model(
    name: str | ModelEntry, train: DataFrame, features: Sequence[str], label: str, seed: int = 42, **overrides
):
    entry = get_model(name) if isinstance(name, str) else name
    return entry.fit(train, list(features), label, {**entry.params, **overrides}, seed)


def score(model, df: DataFrame, out: str = PRED) -> DataFrame:
    """Predict and clip to [0, 1]."""
    return model.predict(df, out).withColumn(out, clip(out))
