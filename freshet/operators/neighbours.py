"""k-nearest-neighbour regression over labelled rows of any number.

Up to ``max_rows`` labelled rows are broadcast once (the size is checked by a count) and every query row is compared
with all of them, block by block, in the task that holds the row: no shuffle, no ids on the query side. More are
indexed, every row, and the index is searched exactly (``neighbour_index``). ``reference_rows`` and ``nearest`` alone
bound the labelled side by a hash of the id, as their parameter says.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.finder import finder
from freshet.operators.neighbour_index import build_index, indexed_predictions

MAX_ROWS = 100_000
BLOCK_ROWS = 4096


@dataclass(frozen=True)
class Reference:
    """Labelled rows in the order of their ids."""

    ids: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def reference_rows(
    train: DataFrame, features: Sequence[str], train_id: str | Sequence[str], label: str, max_rows: int = MAX_ROWS, unique: bool = True,
) -> Reference:
    """At most about ``max_rows`` labelled rows in the order of ``train_id``, one or several columns.

    They must be there and, unless ``unique`` is off, tell the rows apart.
    """
    keys = [train_id] if isinstance(train_id, str) else list(train_id)
    missing = [k for k in keys if k not in train.columns]
    if missing or not keys:
        raise ValueError(f"neighbours need the id columns {missing or 'of a row'}")
    n = train.count()
    t = train.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)], F.col(label).cast("double").alias("_y"))
    keys = [f"_k{i}" for i in range(len(keys))]
    if n > max_rows:
        t = t.where(F.shiftrightunsigned(F.xxhash64(*keys), 12) / F.lit(float(1 << 52)) < max_rows / n)
    table = t.orderBy(*keys).toArrow().to_pandas()  # bounded by max_rows
    if unique and (table.duplicated(keys).any() or table[keys].isna().any(axis=None)):
        raise ValueError(f"{keys} do not tell the labelled rows apart")
    ids = table[keys[0]].to_numpy() if len(keys) == 1 else np.arange(len(table))
    return Reference(ids, table[[f"_f{i}" for i in range(len(features))]].to_numpy(float), table["_y"].to_numpy(float))


def nearest(
    train: DataFrame, queries: DataFrame, features: Sequence[str], train_id: str, query_id: str,
    label: str, k: int = 10, p: int = 2, max_rows: int = MAX_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, train_id, dist, label)`` of the ``k`` nearest labelled rows of each query.

    Equal distances are ordered by the training id.
    """
    known = queries.sparkSession.sparkContext.broadcast(reference_rows(train, features, train_id, label, max_rows))
    find = finder(k, p, block_rows)
    names = (query_id, train_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref = known.value
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.iloc[low : low + 256]
                at, d = find(part.iloc[:, 1:].to_numpy(float), ref.vectors)
                each = at.shape[1]
                yield pd.DataFrame({
                    names[0]: np.repeat(part.iloc[:, 0].to_numpy(), each), names[1]: ref.ids[at].reshape(-1),
                    "dist": d.reshape(-1), "label": ref.labels[at].reshape(-1),
                })

    slim = queries.select(F.col(query_id), *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)])
    kinds = (queries.schema[query_id].dataType.simpleString(), train.schema[train_id].dataType.simpleString())
    return slim.mapInPandas(run, f"`{query_id}` {kinds[0]}, `{train_id}` {kinds[1]}, dist double, label double")


def neighbour_column(
    spark, known: Reference, features: Sequence[str], k: int = 10, weights: str = "distance", p: int = 2, block_rows: int = BLOCK_ROWS
):
    """Prediction as a column of the features; an exact match outweighs everything else. No id is needed."""
    if weights not in ("distance", "uniform"):
        raise ValueError(f"unknown weights {weights!r}")
    shared, find = spark.sparkContext.broadcast(known), finder(k, p, block_rows)

    @F.pandas_udf("double")
    def predict(columns: pd.DataFrame) -> pd.Series:
        ref, out = shared.value, []
        values = columns.to_numpy(float)
        for low in range(0, len(values), 256):
            at, d = find(values[low : low + 256], ref.vectors)
            y = ref.labels[at]
            if weights == "uniform":
                out.append(y.mean(axis=1))
                continue
            exact = d == 0
            weight = np.where(exact.any(axis=1)[:, None], exact.astype(float), 1 / np.where(exact, 1.0, d))
            out.append((y * weight).sum(axis=1) / weight.sum(axis=1))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return predict(F.struct(*[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(features)]))


def knn_predict(
    train: DataFrame, queries: DataFrame, features: Sequence[str], train_id: str, query_id: str,
    label: str, k: int = 10, weights: str = "distance", p: int = 2, max_rows: int = MAX_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, y_pred)``, exact at every size: beyond ``max_rows`` labelled rows an index over all of them is searched."""
    if train.count() > max_rows:
        index = build_index(train, features, train_id, label, k, p)
        return indexed_predictions(index, queries, features, k, weights, "y_pred").select(query_id, "y_pred")
    known = reference_rows(train, features, train_id, label, max_rows)
    value = neighbour_column(queries.sparkSession, known, features, k, weights, p, block_rows)
    return queries.select(query_id, value.alias("y_pred"))
