"""Exact linear-interpolated percentiles at any group size.

``percentile`` keeps a value→count map per group in memory, which is exact and fast for groups
of ordinary size. Beyond the limit the same number is found by sorting: values are counted
first (so repeated values cost one row), running totals locate the two order statistics
around each target rank, and those are interpolated. A table without groups is never sorted: the
ranges of values that hold a wanted rank are narrowed by histograms until each is one value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.operators.ordering import bucket_of, with_running_total
from freshet.runtime import Limits, keep, pin, temporary

#: Buckets of a histogram and rounds of narrowing: the twelfth part of a double's bits each, or more.
_BUCKETS, _ROUNDS = 4096, 8


def groups_fit_memory(df: DataFrame, keys: Sequence[str]) -> bool:
    """True when no group exceeds what one task may hold in a value map; never for a table without keys."""
    if not keys:
        return False
    limits = Limits.of(df.sparkSession)
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return largest <= limits.task_rows


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """One row per group with a column per entry of ``probs``; NULL values are skipped."""
    levels = percentile_array(df, keys, value, list(probs.values()))
    return levels.select(*keys, *[F.get("levels", F.lit(i)).alias(n) for i, n in enumerate(probs)])


def percentile_array(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Like ``exact_percentiles``, as one array column ``levels`` in the order of ``probs``."""
    keys = list(keys)
    probs = [float(p) for p in probs]
    if not keys:
        return _by_narrowing(df.select(F.col(value).cast("double").alias("_v")), probs)
    slim = df.select(*keys, F.col(value).cast("double").alias("_v"))
    if groups_fit_memory(slim, keys):
        return slim.groupBy(*keys).agg(F.percentile("_v", F.array(*map(F.lit, probs))).alias("levels"))
    return _by_rank(slim, keys, probs)


def _by_narrowing(slim: DataFrame, probs: list[float]) -> DataFrame:
    """Levels of the whole table: one pass for its bounds, then a histogram of the open ranges per round.

    A range is the least and greatest value of a histogram bucket, so it shrinks by ``_BUCKETS`` each round and
    ends at one value. The driver sees ``_BUCKETS`` counts per wanted rank. Values so unevenly spread that
    ranges do not close in a few rounds are ranked by sorting instead.
    """
    spark = slim.sparkSession
    with temporary(spark):
        values = pin(slim)
        whole = values.agg(F.count(F.lit(1)).alias("rows"), F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).first()
        schema, n = "levels array<double>", whole["n"]
        if not n:
            return spark.createDataFrame([(None,)] if whole["rows"] else [], schema)
        places = [(n - 1) * p for p in probs]
        found = _order_statistics(values, {r for h in places for r in (math.floor(h), math.ceil(h))}, whole["low"], whole["high"], n)
        if found is None:
            return keep(_by_rank(values.withColumn("_k", F.lit(0)), ["_k"], probs, spread=True).drop("_k"))
        levels = []
        for h in places:
            low, high, part = found[math.floor(h)], found[math.ceil(h)], h - math.floor(h)
            levels.append(low if low == high else low * (1 - part) + high * part)
        return spark.createDataFrame([(levels,)], schema)


def _order_statistics(values: DataFrame, ranks: set[int], low: float, high: float, n: int) -> dict[int, float] | None:
    """Values at the given ranks (from 0); None where ranges do not close."""
    found: dict[int, float] = {}
    # Range -> rows below it and the ranks wanted from it.
    open_ranges = {(low, high): (0, sorted(ranks))}
    for _ in range(_ROUNDS):
        for (a, b), (_, wanted) in list(open_ranges.items()):
            if a == b:
                found.update(dict.fromkeys(wanted, a))
                del open_ranges[a, b]
        if not open_ranges:
            return found
        if any(not math.isfinite(b - a) for a, b in open_ranges):
            return None
        number, place = F.lit(None).cast("int"), F.lit(None).cast("double")
        ranges = sorted(open_ranges)
        for i, (a, b) in enumerate(ranges):
            inside = F.col("_v").between(a, b)
            number = F.when(inside, i).otherwise(number)
            place = F.when(inside, (F.col("_v") - a) / (b - a)).otherwise(place)
        bucket = F.least(F.floor(place * _BUCKETS), F.lit(_BUCKETS - 1))
        rows = values.select("_v", number.alias("i"), bucket.alias("b")).where("i is not null")
        counts = rows.groupBy("i", "b").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")).collect()
        following: dict[tuple[float, float], tuple[int, list[int]]] = {}
        for i, key in enumerate(ranges):
            below, wanted = open_ranges[key]
            for r in sorted((c for c in counts if c["i"] == i), key=lambda c: c["b"]):
                here = [k for k in wanted if below <= k < below + r["n"]]
                if here:
                    following[r["low"], r["high"]] = below, here
                below += r["n"]
        open_ranges = following
    return None


def _by_rank(slim: DataFrame, keys: list[str], probs: list[float], spread: bool = False) -> DataFrame:
    counted = slim.filter(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    sizes = slim.groupBy(*keys).agg(F.count("_v").alias("_total"))
    ranked = with_running_total(counted, keys, "_v", {"_cum": "_n"}, spread).join(sizes, keys)

    # A row stands for ranks (cum - n, cum]. It matters to a level with fractional position h
    # exactly when cum - n - 1 < h < cum; a binary search finds those levels, if any.
    order = sorted(range(len(probs)), key=probs.__getitem__)
    asc = F.array(*[F.lit(probs[i]) for i in order])
    span = F.greatest(F.col("_total") - 1, F.lit(1)).cast("double")
    slack = 1e-9
    first = bucket_of((F.col("_cum") - F.col("_n") - 1) / span - slack, asc, len(probs))
    last = bucket_of(F.col("_cum") / span + slack, asc, len(probs))
    near = ranked.select(
        *keys, "_v", "_n", "_cum", "_total",
        F.explode(F.slice(F.arrays_zip(asc.alias("p"), F.array(*map(F.lit, order)).alias("i")), first + 1, last - first)).alias("_l"),
    )
    h = (F.col("_total") - 1) * F.col("_l.p")
    near = near.withColumn("_h", h).filter((F.col("_h") > F.col("_cum") - F.col("_n") - 1) & (F.col("_h") < F.col("_cum")))
    part = F.col("_h") - F.floor("_h")
    value = F.when(F.min("_v") == F.max("_v"), F.min("_v")).otherwise(
        F.min("_v") * (1 - F.max(part)) + F.max("_v") * F.max(part)
    )
    found = near.groupBy(*keys, F.col("_l.i").alias("_i")).agg(value.alias("_q"))
    # At most one row per level and group from here on.
    listed = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_q"))).alias("_s"))
    listed = listed.select(*keys, F.transform("_s", lambda r: r["_q"]).alias("levels"))
    # Groups without any value keep their row, with NULL.
    return sizes.select(*keys).join(listed, keys, "left")
