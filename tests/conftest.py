import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from freshet.runtime import MAX_SLICES, TASK_ROWS, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 8)


@pytest.fixture
def tight(spark):
    """Limits so low that every group above a few rows is split."""

    def set_limits(task_rows=7, max_slices=20_000):
        spark.conf.set(TASK_ROWS, str(task_rows))
        spark.conf.set(MAX_SLICES, str(max_slices))

    yield set_limits
    for key in (TASK_ROWS, MAX_SLICES):
        spark.conf.unset(key)


@pytest.fixture(scope="session")
def pixels(spark):
    """Three series of 50 hours."""
    rng = np.random.default_rng(42)
    parts = []
    for p in range(3):
        parts.append(pd.DataFrame({
            "time": pd.date_range("2022-01-01", periods=50, freq="h"), "pixel_id": p, "y_idx": 0, "x_idx": p,
            "tp": rng.exponential(0.5, 50), "t2m": rng.normal(20, 5, 50),
        }))
    return ntz(spark, pd.concat(parts, ignore_index=True))


@pytest.fixture(scope="session")
def skewed(spark):
    """One series holds a third of all rows; times are irregular."""
    rng = np.random.default_rng(7)
    n = 600
    pixel = np.where(np.arange(n) % 3 == 0, 7, rng.integers(0, 40, n))
    pdf = pd.DataFrame({
        "time": pd.Timestamp("2022-01-01") + pd.to_timedelta(rng.permutation(n) * 977, unit="s"),
        "pixel_id": pixel, "tp": np.round(rng.exponential(2.0, n), 1), "t2m": rng.normal(size=n),
    })
    return ntz(spark, pdf)


def ntz(spark, pdf):
    """Frame with wall-clock times."""
    df = spark.createDataFrame(pdf)
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp":
            df = df.withColumn(f.name, df[f.name].cast("timestamp_ntz"))
    return df


def rows_of(df, *keys):
    pdf = df.toPandas()
    return pdf.sort_values(list(keys)).reset_index(drop=True)[sorted(pdf.columns)] if keys else pdf
