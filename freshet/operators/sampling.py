"""Reproducible row samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def hash_sample(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """About ``fraction`` of the rows, chosen by a hash of their key.

    The choice depends on the key and seed alone (52 bits of an MD5), so it survives task retries and
    any partitioning, and needs no shuffle.
    """
    if fraction >= 1.0:
        return df
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return df.filter(draw < fraction)


def exact_sample(df: DataFrame, fraction: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``round(fraction · n)`` rows, in hash order of their key."""
    n = df.count()
    order = F.xxhash64(*[F.col(k) for k in keys], F.lit(seed))
    return df.orderBy(order, *keys).limit(int(round(fraction * n)))


def sample_entities(df: DataFrame, entity: str, n: int = 5, seed: int = 42) -> DataFrame:
    """A fixed small set of series."""
    return df.select(entity).distinct().orderBy(F.xxhash64(entity, F.lit(seed)), entity).limit(n)
