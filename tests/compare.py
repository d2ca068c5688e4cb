"""Run named queries beside their SQL statements and compare whole results."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    """None when equal; floats must agree to the last rounded digit or two."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    a, b = _sorted(spark_df), _sorted(sql_df)
    notes = []
    for c in a.columns:
        # Whole numbers with gaps: pandas has them as floats or, from the SQL side, as a nullable type.
        for one, other in ((a, b), (b, a)):
            if one[c].dtype.kind == "f" and str(other[c].dtype) == "Int64" and one[c].isna().any():
                one[c] = one[c].astype("Int64")
        if a[c].dtype.kind != b[c].dtype.kind or (a[c].dtype.kind in "if" and a[c].dtype != b[c].dtype):
            notes.append(f"{c}: type {a[c].dtype} != {b[c].dtype}")
        if pd.api.types.is_float_dtype(a[c]) or pd.api.types.is_float_dtype(b[c]):
            x, y = a[c].astype(float).to_numpy(), b[c].astype(float).to_numpy()
            bad = ~((x == y) | (np.isnan(x) & np.isnan(y)))
            if bad.any():
                notes.append(f"{c}: {bad.sum()} differ, max {np.nanmax(np.abs(x - y)):.2e}")
        else:
            bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
            if bad.any():
                notes.append(f"{c}: {bad.sum()} differ, e.g. {a[c][bad].iloc[0]!r} / {b[c][bad].iloc[0]!r}")
    return "; ".join(notes) or None


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from freshet.runtime import local_session

    spark = local_session("compare", 8)
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        t0 = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            t1 = time.time()
            if name in sql:
                note = differences(got, con.execute(sql[name]).fetchdf())
            else:
                note = None if len(got) else "no rows"
            took = f"{t1 - t0:6.2f}s spark {time.time() - t1:5.2f}s sql"
        except Exception as exc:  # noqa: BLE001
            note, took = f"{type(exc).__name__}: {str(exc)[:600]}", f"{time.time() - t0:6.2f}s"
        failed += note is not None
        print(f"{'FAIL' if note else 'ok  '} {name:24s} {took} {len(got) if note is None else ''} {note or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(min(1, main(sys.argv[1], sys.argv[2:])))
