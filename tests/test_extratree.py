"""The tree with random cuts against a plain one."""

import numpy as np
import pandas as pd
import pytest

from freshet.operators.extratree import draw, fit_extra_tree


def plain(x, y, at, node, depth, out):
    out[node] = y[at].mean()
    if depth == 0 or len(at) < 2 or y[at].min() == y[at].max():
        return
    best = None
    for j in range(x.shape[1]):
        low, high = x[at, j].min(), x[at, j].max()
        cut = low + draw(42, node, j) * (high - low)
        left = x[at, j] <= cut
        if 0 < left.sum() < len(at):
            gain = y[at][left].sum() ** 2 / left.sum() + y[at][~left].sum() ** 2 / (~left).sum()
            if best is None or gain > best[0] * (1 + 1e-12):
                best = gain, left
    if best is not None:
        plain(x, y, at[best[1]], 2 * node + 1, depth - 1, out)
        plain(x, y, at[~best[1]], 2 * node + 2, depth - 1, out)


def test_equals_a_plain_tree(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.normal(size=120), rng.integers(0, 3, 120), np.full(120, 7.0)]).astype(float)
    y = np.sin(x[:, 0]) + x[:, 1] + rng.normal(0, 0.1, 120)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(y=y)).repartition(3)
    tree = fit_extra_tree(df, list("abc"), "y", 5)
    want = {}
    plain(x, y, np.arange(120), 0, 5, want)
    assert tree.means.keys() == want.keys() and all(tree.means[k] == pytest.approx(want[k]) for k in want)
    got = tree.predict(df).toPandas()
    assert ((got.y - got.y_pred) ** 2).mean() < 0.2 * y.var()


def test_flat_labels_and_no_rows(spark):
    flat = spark.createDataFrame([(float(i), 2.0) for i in range(9)], "a double, y double")
    assert fit_extra_tree(flat, ["a"], "y", 3).means == {0: 2.0}
    with pytest.raises(ValueError, match="no complete"):
        fit_extra_tree(flat.where("a < 0"), ["a"], "y", 3)
