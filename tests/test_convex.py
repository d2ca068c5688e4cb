"""Convex losses against brute force."""

import numpy as np
import pandas as pd
import pytest

from freshet.operators.convex import insensitive
from freshet.operators.models import fit_model


def objective(x, y, w, b, c, epsilon):
    return (w @ w + b * b) / 2 + c * np.maximum(np.abs(y - x @ w - b) - epsilon, 0).sum()


@pytest.mark.parametrize("c, epsilon", [(1.0, 0.0), (0.02, 0.1)])
def test_support_vectors_reach_the_optimum(spark, c, epsilon):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 2))
    y = 0.4 + x @ [0.2, -0.1] + rng.standard_t(2, 150) * 0.1
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(y=y)).repartition(4)
    m = fit_model("LinearSVR", df, ["a", "b"], "y", C=c, epsilon=epsilon)
    w, b = np.array(m.weights), m.intercept
    got = objective(x, y, w, b, c, epsilon)
    # Brute force: shrinking grids around the best point so far; the objective is convex.
    best, size = np.array([0.0, 0.0, 0.5]), 1.0
    steps = np.stack(np.meshgrid(*[np.linspace(-1, 1, 9)] * 3), -1).reshape(-1, 3)
    for _ in range(60):
        tried = best + size * steps
        values = [objective(x, y, t[:2], t[2], c, epsilon) for t in tried]
        best, size = tried[int(np.argmin(values))], size * 0.75
    assert got <= min(values) * (1 + 2e-4) and np.allclose([*w, b], best, atol=0.02)


def test_rounded_kinks():
    loss, r = insensitive(0.1, 0.05), np.linspace(-1, 1, 4001)
    value, slope, bend = loss(r)
    assert np.allclose(np.gradient(value, r)[1:-1], slope[1:-1], atol=0.02) and set(np.round(np.unique(bend), 6)) == {0.0, 20.0}
    assert np.abs(value - np.maximum(np.abs(r) - 0.1, 0)).max() <= 0.025 + 1e-12


def test_no_rows_are_an_error(spark):
    with pytest.raises(ValueError, match="no complete"):
        fit_model("LinearSVR", spark.createDataFrame([(None, 1.0)], "a double, y double"), ["a"], "y")
