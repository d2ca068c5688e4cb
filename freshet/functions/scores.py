"""Extremeness scores and the labels derived from them, as column expressions.

All maths is done in double precision. A score is NULL when the value or any threshold is
NULL: an unknown threshold must not read as "most extreme".
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from freshet.config import TargetMode

_TINY = 1e-12


def _double(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def clip(c: Column | str, lo: float = 0.0, hi: float = 1.0) -> Column:
    c = _double(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def _anchored(x: Column, lo: Column, mid: Column, hi: Column, between: Column) -> Column:
    """0 up to ``lo``, 1 from ``hi``, ``between`` inside; NULL if an input is missing."""
    known = x.isNotNull() & lo.isNotNull() & mid.isNotNull() & hi.isNotNull()
    score = F.when(x <= lo, F.lit(0.0)).when(x >= hi, F.lit(1.0)).otherwise(between)
    return F.when(known, clip(score))


def vp_piecewise(x, p90, p95, p100) -> Column:
    """Two straight segments: p90 → 0, p95 → 0.5, p100 → 1."""
    x, lo, mid, hi = map(_double, (x, p90, p95, p100))
    rise = F.lit(0.5) * (x - lo) / F.greatest(mid - lo, F.lit(_TINY))
    top = F.lit(0.5) + F.lit(0.5) * (x - mid) / F.greatest(hi - mid, F.lit(_TINY))
    known = x.isNotNull() & lo.isNotNull() & mid.isNotNull() & hi.isNotNull()
    score = F.when(x <= lo, 0.0).when(x < mid, rise).when(x < hi, top).otherwise(1.0)
    return F.when(known, clip(score))


def vp_sigmoid(x, p90, p95, p100, eps: float = 0.02) -> Column:
    """Logistic curve centred on p95, steep enough to be ``eps`` at p90."""
    x, lo, mid, hi = map(_double, (x, p90, p95, p100))
    k = F.lit(math.log(1.0 / eps - 1.0)) / F.greatest(mid - lo, F.lit(_TINY))
    z = clip(k * (x - mid), -50.0, 50.0)
    return _anchored(x, lo, mid, hi, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def vp_tanh(x, p90, p95, p100, eps: float = 0.02) -> Column:
    """Hyperbolic tangent centred on p95, ``eps`` at p90."""
    x, lo, mid, hi = map(_double, (x, p90, p95, p100))
    span = F.greatest(hi - lo, F.lit(_TINY))
    alpha = F.lit(math.atanh(1.0 - 2.0 * eps)) * span / F.greatest(mid - lo, F.lit(_TINY))
    return _anchored(x, lo, mid, hi, F.lit(0.5) + F.lit(0.5) * F.tanh(alpha * (x - mid) / span))


def vp(x, p90, p95, p100, mode: TargetMode | str = TargetMode.SIGMOID, eps: float = 0.02) -> Column:
    """Dispatch on the configured mapping; an unknown mode is an error."""
    try:
        mode = TargetMode(mode)
    except ValueError:
        raise ValueError(f"unknown target mode {mode!r}; one of {[m.value for m in TargetMode]}") from None
    if mode is TargetMode.PIECEWISE:
        return vp_piecewise(x, p90, p95, p100)
    if mode is TargetMode.SIGMOID:
        return vp_sigmoid(x, p90, p95, p100, eps)
    return vp_tanh(x, p90, p95, p100, eps)


def sigmoid_target(x, p95, slope: float = 2.0, offset: float = 0.0) -> Column:
    """Unsaturated logistic score around ``p95 + offset``."""
    x, mid = _double(x), _double(p95)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-slope) * (x - (mid + F.lit(offset)))))


def is_event(y: Column | str, cutoff: float | Column = 0.5) -> Column:
    """1 when strictly above the cut-off, else 0."""
    return (_double(y) > F.lit(cutoff)).cast("int")


def intensity_band(y: Column | str) -> Column:
    y = _double(y)
    return (
        F.when(y <= 0.0, "below_p90")
        .when(y <= 0.5, "p90_to_p95")
        .when(y < 1.0, "p95_to_p100")
        .when(y >= 1.0, "above_p100")
    )


def residual(y_true: str, y_pred: str) -> Column:
    return _double(y_true) - _double(y_pred)
