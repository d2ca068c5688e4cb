import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from freshet.operators.gramian import moments
from freshet.operators.metrics import evaluate
from freshet.operators.models import _assemble, best_round, fit_model, get_model, model_registry, score
from freshet.operators.neighbours import knn_predict, nearest
from freshet.operators.search import SEARCH_SPACES, draw, search
from tests.conftest import ntz

COLS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5)) * [1, 2, 0.5, 1, 3] + [0, 5, 0, 100, 0]
    w = np.array([0.05, -0.03, 0.1, 0.02, 0.01])
    y = np.clip((x - x.mean(0)) @ w + 0.4 + rng.normal(0, 0.05, 200), 0, 1)
    pdf = pd.DataFrame(x, columns=COLS)
    pdf["y"], pdf["id"], pdf["time"] = y, np.arange(200), pd.date_range("2022-01-01", periods=200)
    return ntz(spark, pdf).cache(), x, y


def centred(x, y):
    return x - x.mean(0), y - y.mean()


def test_registry():
    names = [e.name for e in model_registry()]
    assert len(names) > 10 and len(set(names)) == len(names)
    assert all(not get_model(n).needs_scaling for n in ("DecisionTree", "RandomForest", "GradientBoosting"))
    assert get_model("Ridge").needs_scaling and get_model("KNN").needs_scaling
    with pytest.raises(KeyError):
        get_model("Oracle")
    with pytest.warns(UserWarning):
        assert [e.family for e in model_registry(["D", "ZZ"])] == ["D", "D"]


def test_baselines(table):
    df, _, y = table
    assert fit_model("DummyMean", df, COLS, "y").value == pytest.approx(y.mean())
    assert fit_model("DummyMedian", df, COLS, "y").value == pytest.approx(np.median(y))


@pytest.mark.parametrize("alpha", [0.0, 1.0, 50.0])
def test_ridge_closed_form(table, alpha):
    df, x, y = table
    xc, yc = centred(x, y)
    want = np.linalg.solve(xc.T @ xc + alpha * np.eye(5), xc.T @ yc)
    m = fit_model("Ridge", df, COLS, "y", alpha=alpha)
    assert np.allclose(m.weights, want, atol=1e-7) and m.intercept == pytest.approx(y.mean() - x.mean(0) @ want, abs=1e-5)


def coordinate_descent(x, y, alpha, ratio, rounds=3000):
    xc, yc = centred(x, y)
    n, w = len(y), np.zeros(x.shape[1])
    for _ in range(rounds):
        for j in range(len(w)):
            r = yc - xc @ w + xc[:, j] * w[j]
            z = xc[:, j] @ r / n
            w[j] = np.sign(z) * max(abs(z) - alpha * ratio, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - ratio))
    return w


@pytest.mark.parametrize("name, ratio", [("Lasso", 1.0), ("ElasticNet", 0.5)])
def test_sparse_models(table, name, ratio):
    df, x, y = table
    m = fit_model(name, df, COLS, "y", alpha=0.02)
    assert np.allclose(m.weights, coordinate_descent(x, y, 0.02, ratio), atol=1e-5)


def test_moments(table):
    df, x, y = table
    m = moments(df.repartition(7), COLS, "y")
    xc, yc = centred(x, y)
    assert m.n == 200 and np.allclose(m.xx, xc.T @ xc) and np.allclose(m.xy, xc.T @ yc) and m.yy == pytest.approx(yc @ yc)


def test_bayesian_ridge(table):
    df, x, y = table
    m = fit_model("BayesianRidge", df, COLS, "y")
    xc, yc = centred(x, y)
    ols = np.linalg.solve(xc.T @ xc, xc.T @ yc)
    assert np.allclose(m.weights, ols, atol=5e-3) and np.linalg.norm(m.weights) <= np.linalg.norm(ols)


def test_pls(table):
    df, x, y = table
    xc, yc = centred(x, y)
    ols = np.linalg.solve(xc.T @ xc, xc.T @ yc)
    assert np.allclose(fit_model("PLSRegression", df, COLS, "y").weights, ols, atol=1e-9)  # all components: least squares
    one = np.array(fit_model("PLSRegression", df, COLS, "y", n_components=1).weights)
    xs = xc / x.std(0, ddof=1)
    w = xs.T @ yc
    t = xs @ w
    assert np.allclose(one, w * (t @ yc) / (t @ t) / x.std(0, ddof=1))


def test_transformed_target(table):
    df, _, y = table
    out = score(fit_model("TransformedTarget_Ridge", df, COLS, "y"), df).toPandas()
    assert np.corrcoef(out.y, out.y_pred)[0, 1] > 0.9 and out.y_pred.between(y.min(), y.max()).all()


@pytest.mark.parametrize("name, params", [
    ("DecisionTree", {}), ("RandomForest", {"n_estimators": 10, "max_depth": 6}), ("GradientBoosting", {"n_estimators": 10, "max_depth": 3}),
])
def test_trees_beat_the_mean(table, name, params, tmp_path):
    df, _, _ = table
    m = fit_model(name, df, COLS, "y", **params)
    base = evaluate(score(fit_model("DummyMean", df, COLS, "y"), df), "y").first().rmse
    assert evaluate(score(m, df), "y").first().rmse < 0.8 * base
    m.save(str(tmp_path / "m"))
    assert (tmp_path / "m" / "metadata").exists()


def test_early_stopping(table):
    df, _, _ = table
    held = df.withColumn("held", F.col("id") >= 120).withColumn("y", F.when(F.col("held"), F.rand(1)).otherwise(F.col("y")))
    m = fit_model("GradientBoosting", held, COLS, "y", n_estimators=40, max_depth=2, learning_rate=0.5, validation_col="held")
    assert m.model.getNumTrees < 40


def test_patience_keeps_the_rounds_up_to_the_lowest_error(table):
    df, _, _ = table
    held = df.withColumn("held", F.col("id") % 3 == 0)
    params = {"max_depth": 2, "learning_rate": 0.1, "subsample": 0.8}
    whole = fit_model("GradientBoosting", held.filter("not held"), COLS, "y", n_estimators=24, **params)
    errors = whole.model.evaluateEachIteration(_assemble(held.filter("held"), COLS), "squared")
    for patience in (2, 30):
        m = fit_model("GradientBoosting", held, COLS, "y", n_estimators=24, validation_col="held", patience=patience, **params)
        lowest = best_round(errors, patience)[0]
        assert m.model.getNumTrees == lowest > 3 and errors[lowest - 1] == min(errors[: lowest + patience])
    hasty = fit_model("GradientBoosting", held, COLS, "y", n_estimators=24, validation_col="held", **params)
    assert hasty.model.getNumTrees < lowest


def test_best_round():
    nan = float("nan")
    assert best_round([3, 2, 2, 2.5, 1], 2) == (2, True) and best_round([3, 2, 2, 2.5, 1], 3) == (5, False)
    assert best_round([3, 2, 4], 2) == (2, False) and best_round([1], 5) == (1, False) and best_round([nan] * 4, 2) == (1, True)


def brute_knn(train, test, y, k, p, weights):
    out = []
    for q in test:
        d = np.abs(train - q).sum(1) if p == 1 else np.sqrt(((train - q) ** 2).sum(1))
        near = np.argsort(d, kind="stable")[:k]
        if weights == "uniform":
            out.append(y[near].mean())
        elif (d[near] == 0).any():
            out.append(y[near][d[near] == 0].mean())
        else:
            out.append(np.average(y[near], weights=1 / d[near]))
    return np.array(out)


@pytest.mark.parametrize("p, weights, block", [(2, "distance", 4096), (1, "uniform", 9), (2, "distance", 16)])
def test_knn(spark, p, weights, block):
    """A third of the training rows share one point, so ties are many."""
    rng = np.random.default_rng(5)
    train = np.where(np.arange(300)[:, None] % 3 == 0, 0.5, rng.normal(size=(300, 3)))
    test, y = rng.normal(size=(80, 3)), rng.uniform(size=300)
    test[:5] = 0.5
    make = lambda a: spark.createDataFrame(pd.DataFrame(a, columns=list("abc")).assign(id=np.arange(len(a))))
    t = make(train).join(spark.createDataFrame(pd.DataFrame({"id": np.arange(300), "y": y})), "id")
    out = knn_predict(t, make(test), list("abc"), "id", "id", "y", 7, weights, p, block_rows=block)
    got = out.toPandas().sort_values("id").y_pred.to_numpy()
    assert np.allclose(got, brute_knn(train, test, y, 7, p, weights))


def test_knn_with_fewer_rows_than_k(spark):
    t = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 0.0)], "tid long, a double, y double")
    assert nearest(t, spark.createDataFrame([(9, 0.2)], "qid long, a double"), ["a"], "tid", "qid", "y", k=5).count() == 2


def test_knn_model(table):
    df, x, y = table
    m = fit_model("KNN", df.filter("id < 150"), COLS, "y", n_neighbors=3)
    out = score(m, df.filter("id >= 150")).toPandas().sort_values("time")
    assert np.allclose(out.y_pred, brute_knn(x[:150], x[150:], y[:150], 3, 2, "distance"))


def test_draws_stay_in_range():
    import random

    rng = random.Random(0)
    for _ in range(50):
        p = draw(SEARCH_SPACES["RandomForest"], rng)
        assert 100 <= p["n_estimators"] <= 500 and p["max_features"] in ["sqrt", "log2", 0.5, 0.8]
        assert 1e-4 <= draw(SEARCH_SPACES["Ridge"], rng)["alpha"] <= 100
    with pytest.raises(ValueError):
        draw({"a": ("gauss", 1)}, rng)


def test_search(table):
    df, _, _ = table
    best = search("Ridge", df, COLS, "y", metric="rmse", n_trials=2, n_folds=2, gap=1)
    assert 1e-4 <= best.best_params["alpha"] <= 100 and best.trials.count() == 2
    assert search("Ridge", df, COLS, "y", metric="rmse", n_trials=2, n_folds=2, gap=1).best_params == best.best_params
    assert search("BayesianRidge", df, COLS, "y").best_params == {}
    assert search("Ridge", df, COLS, "y", folds=[]).best_params == {}


def test_failing_trials_rank_last(table):
    df, _, _ = table
    space = {"max_depth": ("categorical", [3, -1])}
    out = search("DecisionTree", df, COLS, "y", "rmse", n_trials=4, n_folds=2, space=space, seed=2)
    scores = {r.params: r.score for r in out.trials.collect()}
    assert out.best_params == {"max_depth": 3} and scores['{"max_depth": -1}'] == float("inf")


@pytest.mark.parametrize("name, more", [("GradientBoosting", {"n_estimators": 2, "max_depth": 2, "validation_col": "held"}), ("DecisionTree", {"max_depth": 2})])
def test_trees_keep_bounded_partitions(spark, monkeypatch, name, more):
    """Every level of a tree reads whole partitions of its rows, however few files the table lies in."""
    from freshet.operators import models

    monkeypatch.setattr(models, "TREE_CELLS", 44 * 22, raising=False)  # 44 rows of two features
    of = {"GradientBoosting": models.GBTRegressor, "DecisionTree": models.DecisionTreeRegressor}[name]
    seen, fit = [], of.fit
    monkeypatch.setattr(of, "fit", lambda self, df: seen.append([len(p) for p in df.rdd.glom().collect()]) or fit(self, df))
    df = spark.range(1000, numPartitions=1).selectExpr("id % 7 as a", "cast(0 as long) as b", "(id % 7) / 7.0 as y", "id % 5 = 0 as held", "id")
    model = fit_model(name, df, ["a", "b"], "y", **more)
    assert sum(seen[0]) == 1000 and max(seen[0]) <= 44 + 1
    assert model.predict(df).where("y_pred is null").count() == 0
