"""Regressions that only need second moments.

One pass over the rows yields a table of mergeable moments: each task reduces its Arrow batches to one
(count, means, centred products) per block of rows, and merging two of them is exact up to rounding, so
Spark combines them in a tree. What reaches the driver is one d×d matrix per block (d = number of
features); the d×d problems are solved there.

Blocks make many fits out of one pass: where training sets are runs of consecutive blocks, such as
walk-forward folds, the moments of every training set are merged from those of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partial results of a block that one merging task takes together.
_FAN_IN = 32


@dataclass(frozen=True)
class Moments:
    """Centred second moments of a training table."""

    n: int
    x_mean: np.ndarray
    y_mean: float
    xx: np.ndarray
    xy: np.ndarray
    yy: float


@dataclass(frozen=True)
class Joint:
    """Count, means and centred products of some columns; ``a + b`` describes the rows of both."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> "Joint":
        mean = rows.mean(axis=0)
        gap = rows - mean
        return cls(float(len(rows)), mean, gap.T @ gap)

    def __add__(self, other: "Joint") -> "Joint":
        if not self.n or not other.n:
            return self if self.n else other
        n, gap = self.n + other.n, other.mean - self.mean
        return Joint(n, self.mean + gap * (other.n / n), self.products + other.products + np.outer(gap, gap) * (self.n * other.n / n))

    def split(self) -> Moments:
        """The last column is the label."""
        return Moments(int(self.n), self.mean[:-1], float(self.mean[-1]), self.products[:-1, :-1], self.products[:-1, -1], float(self.products[-1, -1]))

    def row(self) -> tuple[float, bytes, bytes]:
        return self.n, self.mean.tobytes(), self.products.tobytes()

    @classmethod
    def read(cls, n: float, mean: bytes, products: bytes) -> "Joint":
        centre = np.frombuffer(mean)
        return cls(n, centre, np.frombuffer(products).reshape(len(centre), len(centre)))


_PARTIAL = "block int, salt int, n double, mean binary, products binary"


def moment_table(df: DataFrame, features: Sequence[str], label: str, block: Column | None = None) -> dict[int, Joint]:
    """Moments of every block; rows with a NULL in a feature, the label or ``block`` are skipped.

    The number of blocks must be bounded by the caller: their matrices come to the driver.
    """
    number = F.lit(0) if block is None else block.cast("int")
    slim = df.select(number.alias("block"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*features, label])]).dropna()

    def frame(found: list[tuple[int, int, Joint]]) -> pd.DataFrame:
        return pd.DataFrame([(b, s, *j.row()) for b, s, j in found], columns=["block", "salt", "n", "mean", "products"])

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held: dict[int, Joint] = {}
        for batch in batches:
            values = batch.to_numpy(dtype=float)
            blocks = values[:, 0].astype(int)
            for b in np.unique(blocks).tolist():
                more = Joint.of(values[blocks == b, 1:])
                held[b] = held[b] + more if b in held else more
        yield frame([(b, TaskContext.get().partitionId() % _FAN_IN, j) for b, j in held.items()])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        ordered = part.sort_values(["n", "mean"])  # whatever the order of arrival, the same sum
        whole = reduce(Joint.__add__, (Joint.read(*r) for r in zip(ordered.n, ordered["mean"], ordered.products)))
        return frame([(int(part.block.iloc[0]), int(part.salt.iloc[0]), whole)])

    partial = slim.mapInPandas(summarise, _PARTIAL).groupBy("block", "salt").applyInPandas(merge, _PARTIAL)
    out: dict[int, Joint] = {}
    for r in partial.orderBy("block", "salt").toLocalIterator():
        more = Joint.read(r["n"], bytes(r["mean"]), bytes(r["products"]))
        out[r["block"]] = out[r["block"]] + more if r["block"] in out else more
    return out


class MomentTree:
    """Sums of any run of blocks by about 2·log2(blocks) merges; no differences, so nothing cancels."""

    def __init__(self, blocks: dict[int, Joint], size: int):
        self.size = size
        self.nodes: list[Joint | None] = [None] * size + [blocks.get(i) for i in range(size)]
        for i in range(size - 1, 0, -1):
            self.nodes[i] = _merged(self.nodes[2 * i], self.nodes[2 * i + 1])

    def run(self, first: int, last: int) -> Joint | None:
        """Rows of the blocks first..last, both included; None if there are none."""
        low, high, left, right = first + self.size, last + 1 + self.size, None, None
        while low < high:
            if low & 1:
                left, low = _merged(left, self.nodes[low]), low + 1
            if high & 1:
                high -= 1
                right = _merged(self.nodes[high], right)
            low, high = low >> 1, high >> 1
        return _merged(left, right)


def _merged(a: Joint | None, b: Joint | None) -> Joint | None:
    return b if a is None else a if b is None else a + b


def moments(df: DataFrame, features: Sequence[str], label: str) -> Moments:
    """Centred moments of the whole table; rows with a NULL are skipped."""
    found = moment_table(df, features, label)
    if not found:
        raise ValueError("no complete training rows")
    return found[0].split()


def ridge(m: Moments, alpha: float) -> tuple[np.ndarray, float]:
    """Squared error + alpha·|w|², the intercept free; of several best solutions the shortest."""
    system = m.xx + alpha * np.eye(len(m.xy))
    w = np.linalg.solve(system, m.xy) if alpha > 0 else np.linalg.lstsq(system, m.xy, rcond=None)[0]
    return w, m.y_mean - float(m.x_mean @ w)


def sparse_path(m: Moments, alphas: Sequence[float], l1_ratio: float, max_iter: int = 5000, tol: float = 1e-10) -> list[tuple[np.ndarray, float]]:
    """Squared error / (2n) + alpha·(l1_ratio·|w| + (1 - l1_ratio)/2·w²) for every alpha, largest first, from one matrix.

    Coordinate descent on the moment matrix: the gradient is kept up to date by one of its columns per changed
    weight, sweeps stay on the active set until it settles, then one full sweep looks for newcomers, and each
    alpha starts from the solution of the one before. ``max_iter`` bounds the sweeps of an alpha. Results come
    in the order of ``alphas``.
    """
    xx, xy = m.xx / m.n, m.xy / m.n
    size = np.diag(xx).copy()
    scale = max(m.yy / m.n, np.finfo(float).tiny)
    w, gap = np.zeros(len(xy)), xy.copy()  # gap = xy - xx w
    found: dict[int, tuple[np.ndarray, float]] = {}

    def sweep(coordinates: np.ndarray, l1: float, l2: float) -> float:
        """Largest fall of the squared error by one coordinate."""
        most = 0.0
        for j in coordinates:
            if size[j] + l2 <= 0:
                continue
            z = gap[j] + size[j] * w[j]
            new = np.sign(z) * max(abs(z) - l1, 0.0) / (size[j] + l2)
            change = new - w[j]
            if change:
                gap[:] -= xx[:, j] * change
                w[j] = new
                most = max(most, (size[j] + l2) * change * change)
        return most

    everyone = np.arange(len(xy))
    for k in sorted(range(len(alphas)), key=lambda i: -alphas[i]):
        l1, l2 = alphas[k] * l1_ratio, alphas[k] * (1 - l1_ratio)
        left = max_iter
        while left > 0:
            left -= 1
            if sweep(everyone, l1, l2) <= tol * tol * scale:
                break
            while left > 0:
                left -= 1
                if sweep(np.flatnonzero(w), l1, l2) <= tol * tol * scale:
                    break
        found[k] = w.copy(), m.y_mean - float(m.x_mean @ w)
    return [found[k] for k in range(len(alphas))]


def bayesian_ridge(m: Moments, max_iter: int = 300, tol: float = 1e-3, prior: float = 1e-6) -> tuple[np.ndarray, float]:
    """Evidence maximisation for noise and weight precision; returns (weights, intercept)."""
    eig, vec = np.linalg.eigh(m.xx)
    eig = np.maximum(eig, 0.0)
    projected = vec.T @ m.xy
    noise = 1.0 / (m.yy / m.n + np.finfo(float).eps)
    weight = 1.0

    def solve() -> np.ndarray:
        return vec @ (projected / (eig + weight / noise))

    previous = None
    for _ in range(max_iter):
        w = solve()
        sse = max(m.yy - 2 * w @ m.xy + w @ m.xx @ w, 0.0)
        effective = np.sum(noise * eig / (weight + noise * eig))
        weight = (effective + 2 * prior) / (w @ w + 2 * prior)
        noise = (m.n - effective + 2 * prior) / (sse + 2 * prior)
        if previous is not None and np.abs(previous - w).sum() < tol:
            break
        previous = w
    w = solve()
    return w, m.y_mean - float(m.x_mean @ w)


def partial_least_squares(m: Moments, n_components: int = 5) -> tuple[np.ndarray, float]:
    """Single-response PLS on standardised columns; returns (weights, intercept) in raw units."""
    dof = max(m.n - 1, 1)
    sx = np.sqrt(np.diag(m.xx) / dof)
    sx[sx == 0] = 1.0
    sy = np.sqrt(m.yy / dof) or 1.0
    xx, xy = m.xx / np.outer(sx, sx), m.xy / (sx * sy)
    weights, loadings, scores = [], [], []
    for _ in range(min(n_components, len(xy))):
        size = np.linalg.norm(xy)
        if size < 1e-12:
            break
        w = xy / size
        tt = w @ xx @ w
        if tt < 1e-12:
            break
        p, q = xx @ w / tt, xy @ w / tt
        xx = xx - tt * np.outer(p, p)
        xy = xy - tt * q * p
        weights.append(w), loadings.append(p), scores.append(q)
    if not weights:
        return np.zeros(len(m.xy)), m.y_mean
    W, P, q = np.array(weights).T, np.array(loadings).T, np.array(scores)
    coef = W @ np.linalg.solve(P.T @ W, q) * sy / sx
    return coef, m.y_mean - float(m.x_mean @ coef)
