"""Per-row training losses, usable as metric expressions (``F.avg(loss(...))``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from freshet.functions.scores import clip


def loss(name: str, y_true: str, y_pred: str, gamma: float = 2.0, alpha: float = 0.25, delta: float = 0.1) -> Column:
    """``mse``, ``bce``, ``focal`` or ``huber`` of one row."""
    y, p = F.col(y_true).cast("double"), F.col(y_pred).cast("double")
    err = p - y
    if name == "mse":
        return err * err
    if name == "bce":
        q = F.when(p.isNotNull(), p)
        # Logs are floored at -100 so that a hard 0/1 prediction stays finite.
        log_p = F.greatest(F.when(q > 0, F.ln(q)).when(q <= 0, F.lit(-100.0)), F.lit(-100.0))
        log_n = F.greatest(F.when(q < 1, F.ln(1 - q)).when(q >= 1, F.lit(-100.0)), F.lit(-100.0))
        return -(y * log_p + (1 - y) * log_n)
    if name == "focal":
        q = clip(p, 1e-7, 1.0 - 1e-7)
        p_t = y * q + (1 - y) * (1 - q)
        a_t = y * F.lit(alpha) + (1 - y) * F.lit(1.0 - alpha)
        bce = -(y * F.ln(q) + (1 - y) * F.ln(1 - q))
        return a_t * F.pow(1 - p_t, F.lit(gamma)) * bce
    if name == "huber":
        size = F.abs(err)
        return F.when(size < delta, 0.5 * err * err).otherwise(F.lit(delta) * (size - F.lit(0.5 * delta)))
    raise ValueError(f"unknown loss {name!r}; one of mse, bce, focal, huber")
