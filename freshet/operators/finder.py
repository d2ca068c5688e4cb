"""Distances and k nearest rows of one block in numpy, for use inside tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def distance(p: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Distances of order ``p`` (1 or 2) between the rows of two matrices, summed column by column.

    Nested, like ``finder``, so that it travels by value to workers that lack this package.
    """

    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((len(a), len(b)))
        for j in range(a.shape[1]):
            gap = a[:, j, None] - b[None, :, j]
            out += np.abs(gap) if p == 1 else gap * gap
        return out if p == 1 else np.sqrt(out, out=out)

    return distances


def finder(k: int, p: int, block_rows: int) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Positions and distances of the k nearest rows; equal distances go to the lower position."""

    distances = distance(p)

    def find(queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best = np.zeros((len(queries), 0), int), np.zeros((len(queries), 0))
        for low in range(0, len(vectors), block_rows):
            d = distances(queries, vectors[low : low + block_rows])
            if best[0].shape[1] == k and k < d.shape[1]:
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                level = np.take_along_axis(d, near, 1).max(axis=1)
                worse = level > best[1][:, -1]
                # Where the k-th here is tied, the partition may have left out a lower position.
                tied = (d <= level[:, None]).sum(axis=1) > k
                full = tied & ~worse if worse.any() else tied
            else:
                near, full = None, np.ones(len(d), bool)
            if near is None or full.any():
                whole = np.argsort(d, axis=1, kind="stable")[:, :k]
                near = whole if near is None else np.where(full[:, None], whole, near)
            both_at = np.concatenate([best[0], near + low], axis=1)
            both_d = np.concatenate([best[1], np.take_along_axis(d, near, 1)], axis=1)
            order = np.lexsort((both_at, both_d), axis=1)[:, :k]
            best = np.take_along_axis(both_at, order, 1), np.take_along_axis(both_d, order, 1)
        return best

    return find
