"""A regression tree with random cuts, grown level by level.

At every node one cut per feature is drawn uniformly between the feature's least and greatest value there, and the
cut with the greatest fall of squared error is taken. Two grouped aggregates per level serve all its nodes: bounds
of the features, then counts and sums on the left of the drawn cuts. Draws depend on seed, node and feature only.
What reaches the driver is a row per node of the level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.runtime import pin, temporary


def draw(seed: int, node: int, feature: int) -> float:
    """A number in [0, 1) for a cut."""
    return int(hashlib.md5(f"{seed}-{node}-{feature}".encode()).hexdigest()[:8], 16) / 4294967296.0


@dataclass(frozen=True)
class ExtraTree:
    """Cuts and means by node; the children of node k are 2k + 1 (at most the cut) and 2k + 2."""

    features: tuple[str, ...]
    cuts: dict[int, tuple[int, float]]
    means: dict[int, float]

    def predict(self, df: DataFrame, out: str = "y_pred") -> DataFrame:
        nodes, means = node_of(self.features, self.cuts), self.means

        @F.pandas_udf("double")
        def mean_of(node: pd.Series) -> pd.Series:
            return node.map(means)

        return df.withColumn(out, mean_of(nodes))


def node_of(features: Sequence[str], cuts: dict[int, tuple[int, float]]) -> Column:
    """The leaf that a row falls into."""
    size = max(cuts, default=-1) + 1
    feature, cut = np.full(max(size, 1), -1), np.zeros(max(size, 1))
    for k, (j, c) in cuts.items():
        feature[k], cut[k] = j, c

    @F.pandas_udf("long")
    def walk(columns: pd.DataFrame) -> pd.Series:
        x = columns.to_numpy(dtype=float)
        at = np.zeros(len(x), np.int64)
        while True:
            inner = at < len(feature)
            inner[inner] = feature[at[inner]] >= 0
            if not inner.any():
                return pd.Series(at)
            here = at[inner]
            right = x[inner, feature[here]] > cut[here]
            at[inner] = 2 * here + 1 + right

    return walk(F.struct(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(features)]))


def fit_extra_tree(df: DataFrame, features: Sequence[str], label: str, max_depth: int, min_samples_split: int = 2, seed: int = 42) -> ExtraTree:
    """Rows with a NULL are skipped. Of equally good cuts the first feature's is taken."""
    d = len(features)
    names = [f"c{i}" for i in range(d)]
    cuts: dict[int, tuple[int, float]] = {}
    means: dict[int, float] = {}
    with temporary(df.sparkSession):
        rows = pin(df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(features, names)], F.col(label).cast("double").alias("y")).dropna())
        for depth in range(max_depth + 1):
            placed = rows.select("*", node_of(names, cuts).alias("node")).where(F.col("node") >= 2**depth - 1)
            bounds = [f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("low", F.min), ("high", F.max))]
            found = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.min("y").alias("y0"), F.max("y").alias("y1"), *bounds).collect()
            means.update({r["node"]: r["s"] / r["n"] for r in found})
            opened = [r for r in found if r["n"] >= min_samples_split and r["y0"] < r["y1"]]
            drawn = {r["node"]: [r[f"low{i}"] + draw(seed, r["node"], i) * (r[f"high{i}"] - r[f"low{i}"]) for i in range(d)] for r in opened}
            if depth == max_depth or not drawn:
                break
            table = df.sparkSession.createDataFrame([(k, c) for k, c in drawn.items()], "node long, cuts array<double>")
            left = [F.col(n) <= F.get("cuts", F.lit(i)) for i, n in enumerate(names)]
            sides = [a for i, w in enumerate(left) for a in (F.count_if(w).alias(f"n{i}"), F.sum(F.when(w, F.col("y"))).alias(f"s{i}"))]
            # A row per node of the level.
            sums = placed.join(F.broadcast(table), "node").groupBy("node").agg(*sides).collect()
            whole = {r["node"]: r for r in opened}
            for r in sums:
                n, s, best = whole[r["node"]]["n"], whole[r["node"]]["s"], None
                for i in range(d):
                    a, b = r[f"n{i}"], n - r[f"n{i}"]
                    if a and b:
                        gain = r[f"s{i}"] ** 2 / a + (s - r[f"s{i}"]) ** 2 / b
                        if best is None or gain > best[0] + 1e-12 * abs(best[0]):
                            best = gain, i
                if best is not None:
                    cuts[r["node"]] = best[1], drawn[r["node"]][best[1]]
    if not means:
        raise ValueError("no complete training rows")
    return ExtraTree(tuple(features), cuts, means)
