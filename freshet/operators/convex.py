"""Linear models under a convex loss of the residual, fitted by Newton steps on sums that Spark adds up.

A pass over the rows gives value, gradient and curvature of the objective at one point, another the values at
several step lengths; tasks reduce their Arrow batches, Spark adds the results in a tree, and the driver solves a
system of d numbers (d = number of features and the intercept). Losses with a kink are rounded off over a width
that shrinks from stage to stage, each starting from the solution before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.runtime import pin, temporary

#: Value, first and second derivative of a loss at residuals.
Loss = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: Step lengths tried in one pass.
_STEPS = tuple(0.5**k for k in range(10))
_FAN_IN = 32


def insensitive(epsilon: float, width: float) -> Loss:
    """max(0, |r| - epsilon), its kink rounded by a parabola of that width."""

    def loss(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.abs(r) - epsilon
        value = np.where(z < 0, 0.0, np.where(z < width, z * z / (2 * width), z - width / 2))
        return value, np.sign(r) * np.clip(z / width, 0.0, 1.0), ((z > 0) & (z < width)) / width

    return loss


def _summed(rows: DataFrame, measure: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all rows of what ``measure`` gives for a block of them, an array of ``size`` numbers."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            total += measure(batch.to_numpy(dtype=float))
        yield pd.DataFrame({"salt": [TaskContext.get().partitionId() % _FAN_IN], "sums": [total]})

    def add(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"salt": part["salt"].iloc[:1], "sums": [np.sum(np.stack(part["sums"].tolist()), axis=0)]})

    schema = "salt int, sums array<double>"
    found = rows.mapInPandas(reduce, schema).groupBy("salt").applyInPandas(add, schema).collect()
    return np.sum([r["sums"] for r in sorted(found, key=lambda r: r["salt"])], axis=0) if found else np.zeros(size)


def minimise(
    df: DataFrame, features: Sequence[str], label: str, stages: Sequence[Loss], weight: float, max_iter: int = 100, tol: float = 1e-9,
) -> tuple[np.ndarray, float]:
    """(weights, intercept) that minimise (|weights|² + intercept²) / 2 + weight · the sum of losses, stage by stage.

    Rows with a NULL are skipped; no row at all is an error. ``max_iter`` bounds the steps of all stages together.
    """
    d = len(features) + 1
    with temporary(df.sparkSession):
        rows = pin(df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*features, label])]).dropna())
        if rows.isEmpty():
            raise ValueError("no complete training rows")
        at, left = np.zeros(d), max_iter

        def residual(block: np.ndarray, point: np.ndarray) -> np.ndarray:
            return block[:, -1] - block[:, :-1] @ point[:-1] - point[-1]

        for loss in stages:
            while left > 0:
                left -= 1

                def local(block: np.ndarray, here=at, loss=loss) -> np.ndarray:
                    value, slope, bend = loss(residual(block, here))
                    x = np.column_stack([block[:, :-1], np.ones(len(block))])
                    return np.concatenate(([value.sum()], x.T @ slope, (x.T @ (x * bend[:, None])).ravel()))

                sums = weight * _summed(rows, local, 1 + d + d * d)
                value = at @ at / 2 + sums[0]
                gradient, curvature = at - sums[1 : d + 1], np.eye(d) + sums[d + 1 :].reshape(d, d)
                step = -np.linalg.solve(curvature, gradient)
                promised = -gradient @ step
                if promised <= tol * max(value, 1e-12):
                    break

                def along(block: np.ndarray, here=at, step=step, loss=loss) -> np.ndarray:
                    return np.array([loss(residual(block, here + s * step))[0].sum() for s in _STEPS])

                values = weight * _summed(rows, along, len(_STEPS)) + [((at + s * step) ** 2).sum() / 2 for s in _STEPS]
                best = int(np.argmin(values))
                if values[best] >= value:
                    break
                at = at + _STEPS[best] * step
    return at[:-1], float(at[-1])
