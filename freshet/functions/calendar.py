"""Calendar features of a timestamp column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CYCLES = ("hour_sin", "hour_cos", "month_sin", "month_cos", "doy_sin", "doy_cos")


def cyclical(time: str) -> dict[str, Column]:
    """Hour of day, month and day of year on the unit circle."""
    turn = F.lit(2 * math.pi)
    hour = turn * F.hour(time) / F.lit(24.0)
    month = turn * (F.month(time) - 1) / F.lit(12.0)
    doy = turn * F.dayofyear(time) / F.lit(365.25)
    angles = {"hour": hour, "month": month, "doy": doy}
    return {f"{n}_{f}": getattr(F, f)(a) for n, a in angles.items() for f in ("sin", "cos")}


def season(time: str) -> Column:
    """Southern-hemisphere meteorological season."""
    m = F.month(time)
    return (
        F.when(m.isin(12, 1, 2), "DJF_wet")
        .when(m.isin(3, 4, 5), "MAM_trans")
        .when(m.isin(6, 7, 8), "JJA_dry")
        .when(m.isin(9, 10, 11), "SON_trans")
    )
