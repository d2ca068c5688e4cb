"""Exact nearest neighbours among any number of labelled rows: an inverted index of posting lists.

Fit, with every row indexed:

1. Of rows with equal vectors only the ``k`` lowest ids can be neighbours of anything; the others are left out. That
   is exact, and a vector that a third of all rows share becomes ``k`` rows.
2. Up to ``MAX_LISTS`` coarse centres are vectors drawn by their hash (the documented, bounded sample). Every row is
   posted under its nearest centre, in the *ring* of its distance to it.
3. The rows of a ring lie in blocks of about ``block_rows``, one row of the table ``blocks`` each.

Search, over distinct query vectors: a query first visits one ring of its nearest list. The k-th distance found there,
or a bound from the triangle inequality, limits which rings of which lists can hold a nearer row; it visits all of
those. Visits of a ring are packed into chunks and joined with its blocks, so a task sees one chunk and one block at a
time, however many queries or rows meet there. Chunks are dealt to as many tasks as the visits need, those of a ring in
many hands, each with its own copy of the ring's blocks. Nothing is dropped: with few dimensions few rings are visited,
with many the search is slower but still exact. What is broadcast or gathered is one row per list or ring.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.operators.finder import distance, finder
from freshet.runtime import pin, ship

MAX_LISTS = 4096
BLOCK_ROWS = 2048
#: Query vectors that are compared with a block at once.
CHUNK = 256
#: Chunks of a ring that stay together, with one copy of its blocks.
HAND = 32
#: Rows that one task sorts by vector.
TASK_ROWS = 1_000_000
#: Visits and indexed rows that one task brings together.
TASK_VISITS = 250_000
#: Candidates that one task sorts.
TASK_CANDIDATES = 1_000_000
#: Relative slack of bounds, far above rounding errors of distances.
SLACK = 1e-9


@dataclass(frozen=True)
class Lists:
    """One entry per posting list: its centre, least and greatest distance to it, number of rings and of rows."""

    centres: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rings: np.ndarray
    rows: np.ndarray


@dataclass(frozen=True)
class NeighbourIndex:
    blocks: DataFrame
    lists: Lists
    k: int
    p: int


def vector(features: Sequence[str]) -> Column:
    """Features as an array, null unless all are finite numbers. Adding 0 turns -0.0 into 0.0."""
    v = F.array(*[F.col(f"`{c}`").cast("double") + F.lit(0.0) for c in features])
    return F.when(F.forall(v, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), v)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _vectors(values: np.ndarray) -> pa.Array:
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).reshape(-1)))


def _parts(df: DataFrame, size: int) -> DataFrame:
    """Into how many parts of about ``size`` rows each ring is cut. A ring stands for about a block of indexed rows."""
    return df.groupBy("list", "ring").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))


def _salted(df: DataFrame, parts: DataFrame, by: Column) -> DataFrame:
    """A part per row, by a hash. Rows are not shuffled for it, so a large ring is never in one task."""
    return df.join(F.broadcast(parts), ["list", "ring"]).withColumn("part", F.pmod(F.xxhash64(by), "parts")).drop("parts")


def _tasks(spark: SparkSession, rows: int, each: int) -> int:
    return max(-(-rows // each), spark.sparkContext.defaultParallelism)


def build_index(
    train: DataFrame, features: Sequence[str], train_id: str | Sequence[str], label: str, k: int = 10, p: int = 2,
    lists: int | None = None, block_rows: int = BLOCK_ROWS,
) -> NeighbourIndex | None:
    """Index of all rows with a label and finite features; None without any. It serves up to ``k`` neighbours.

    ``train_id``, one or several columns, orders equal distances. Repeated ids are rows of their own.
    """
    keys = [train_id] if isinstance(train_id, str) else list(train_id)
    missing = [c for c in keys if c not in train.columns]
    if missing or not keys:
        raise ValueError(f"neighbours need the id columns {missing or 'of a row'}")
    own = F.col(f"`{keys[0]}`") if len(keys) == 1 else F.struct(*[F.col(f"`{c}`") for c in keys])
    rows = train.select(own.alias("id"), vector(features).alias("v"), F.col(f"`{label}`").cast("double").alias("y"))
    first = Window.partitionBy("v").orderBy("id", "y")
    # Each task sorts its rows to leave out all but k of a vector before they are shuffled, so rows are dealt evenly first: a file's share may hold any number.
    dealt = rows.where("v is not null and y is not null").repartition(_tasks(train.sparkSession, train.count(), TASK_ROWS), F.xxhash64("id", "v", "y"))
    rows = pin(dealt.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k).drop("nth"))
    n, width = rows.count(), len(features)
    if not n:
        return None
    wanted = min(max(lists or -(-n // block_rows), 1), MAX_LISTS)
    drawn = rows.select("v", F.xxhash64("v").alias("h")).where("h is not null").dropDuplicates(["v"]).orderBy("h", "v").limit(wanted)
    centres = np.array([r.v for r in drawn.collect()], float)  # bounded by MAX_LISTS
    ship(train.sparkSession)
    shared, between = train.sparkSession.sparkContext.broadcast(centres), distance(p)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch.column("v"), width)
            at, r = np.zeros(len(values), np.int32), np.zeros(len(values))
            for a in range(0, len(values), CHUNK):
                d = between(values[a : a + CHUNK], shared.value)
                at[a : a + CHUNK], r[a : a + CHUNK] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(r)], ["id", "v", "y", "list", "r"])

    kind = rows.schema["id"].dataType.simpleString()
    posted = pin(rows.mapInArrow(assign, f"id {kind}, v array<double>, y double, list int, r double"))
    sizes = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))
    sizes = pin(sizes.withColumn("rings", F.ceil(F.col("n") / block_rows).cast("int")))
    known = {s.list: s for s in sizes.collect()}  # bounded by MAX_LISTS
    used = sorted(known)
    of = Lists(centres[used], *(np.array([known[i][c] for i in used], t) for c, t in (("low", float), ("high", float), ("rings", int), ("n", int))))
    number = {i: at for at, i in enumerate(used)}
    dense = F.element_at(F.create_map(*[F.lit(x) for pair in number.items() for x in pair]), F.col("list")) if used != list(range(len(used))) else F.col("list")
    span = F.col("high") - F.col("low")
    ring = F.when(span > 0, F.least(F.floor((F.col("r") - F.col("low")) / span * F.col("rings")), F.col("rings") - 1)).otherwise(0)
    placed = posted.join(F.broadcast(sizes), "list").select(dense.cast("int").alias("list"), ring.cast("int").alias("ring"), "id", "v", "y")
    placed = pin(placed)
    cut = _salted(placed, _parts(placed, block_rows), F.struct("id", "v", "y"))
    packed = cut.groupBy("list", "ring", "part").agg(F.sort_array(F.collect_list(F.struct("id", "y", "v"))).alias("m"))
    blocks = packed.select(
        "list", "ring", F.col("m.id").alias("ids"), F.col("m.y").alias("labels"), F.flatten("m.v").alias("vectors")
    )
    return NeighbourIndex(pin(blocks), of, k, p)


def _visit(index: NeighbourIndex, visits: DataFrame, n: int) -> DataFrame:
    """Candidates (v, id, dist, label): the nearest rows, not beyond ``most``, of each block that one of ``n`` ``(v, list, ring, most)`` meets."""
    parts, place = _parts(visits, CHUNK), ["list", "ring", "hand"]
    tasks = _tasks(visits.sparkSession, n + int(index.lists.rows.sum()), TASK_VISITS)
    # Both sides are dealt by hand: a ring that many queries visit, or many rows share, is in many tasks.
    dealt = _salted(visits, parts, F.col("v")).withColumn("hand", F.floor(F.col("part") / HAND)).repartition(tasks, *place)
    chunks = dealt.groupBy(*place, "part").agg(F.collect_list(F.struct("v", "most")).alias("vs"))
    hands = F.sequence(F.lit(0), F.floor((F.col("parts") - 1) / HAND))
    blocks = index.blocks.join(F.broadcast(parts), ["list", "ring"]).withColumn("hand", F.explode(hands)).drop("parts").repartition(tasks, *place)
    met = chunks.select(*place, F.flatten("vs.v").alias("queries"), F.col("vs.most").alias("most")).join(blocks, place)
    find, width = finder(index.k, index.p, BLOCK_ROWS), index.lists.centres.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("queries", "vectors", "ids", "labels", "most")]
            for i in range(batch.num_rows):
                queries, vectors = (c[i].values.to_numpy(zero_copy_only=False).reshape(-1, width) for c in columns[:2])
                at, d = find(queries, vectors)
                most = columns[4][i].values.to_numpy(zero_copy_only=False)
                of, nth = np.nonzero(d <= (most + SLACK * (1 + most))[:, None])
                taken = pa.array(at[of, nth])
                yield pa.RecordBatch.from_arrays(
                    [_vectors(queries[of]), columns[2][i].values.take(taken), pa.array(d[of, nth]), columns[3][i].values.take(taken)],
                    ["v", "id", "dist", "label"],
                )

    kind = index.blocks.schema["ids"].dataType.elementType.simpleString()
    return met.select("queries", "vectors", "ids", "labels", "most").mapInArrow(work, f"v array<double>, id {kind}, dist double, label double")


def _first(found: DataFrame, k: int, rows: int) -> DataFrame:
    """The k nearest of each ``v`` among about ``rows`` candidates, dealt to as many tasks as they need before they are sorted."""
    found = found.withColumn("h", F.xxhash64("v")).repartition(_tasks(found.sparkSession, rows, TASK_CANDIDATES), "h")
    nearest = Window.partitionBy("h", "v").orderBy("dist", "id", "label")
    return found.withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= k).drop("nth", "h")


def search(index: NeighbourIndex, vectors: DataFrame, k: int | None = None) -> DataFrame:
    """(v, id, dist, label) of the ``k`` nearest rows of each distinct non-null ``v``; equal distances by id."""
    k = index.k if k is None else k
    if not 0 < k <= index.k:
        raise ValueError(f"the index serves up to {index.k} neighbours")
    ship(vectors.sparkSession)
    width, between = index.lists.centres.shape[1], distance(index.p)
    shared = vectors.sparkSession.sparkContext.broadcast(index.lists)

    def ring_of(of: Lists, at: np.ndarray, r: np.ndarray) -> np.ndarray:
        span = of.high[at] - of.low[at]
        part = np.divide(r - of.low[at], span, out=np.zeros(len(at)), where=span > 0)
        return np.clip(np.floor(part * of.rings[at]), 0, of.rings[at] - 1).astype(np.int32)

    def visited(batches: Iterator[pa.RecordBatch], again: bool) -> Iterator[pa.RecordBatch]:
        """First visits, or with ``again`` all others that the bound leaves."""
        of = shared.value
        for batch in batches:
            values = _matrix(batch.column("v"), width)
            reached = batch.column("reached").to_numpy(zero_copy_only=False) if again else None
            for a in range(0, len(values), CHUNK):
                q = values[a : a + CHUNK]
                d = between(q, of.centres)
                home = d.argmin(axis=1)
                at_home = ring_of(of, home, d[np.arange(len(q)), home])
                if not again:
                    yield pa.RecordBatch.from_arrays([_vectors(q), pa.array(home.astype(np.int32)), pa.array(at_home), pa.array(np.full(len(q), np.inf))], ["v", "list", "ring", "most"])
                    continue
                # All rows of the lists with the least greatest distances, until they are k.
                order = np.argsort(d + of.high, axis=1)
                enough = (np.cumsum(of.rows[order], axis=1) < k).sum(axis=1)
                some = np.minimum(enough, d.shape[1] - 1)
                far = np.take_along_axis(d + of.high, np.take_along_axis(order, some[:, None], 1), 1)[:, 0]
                limit = np.where(enough < d.shape[1], np.fmin(far, reached[a : a + CHUNK]), np.inf)
                slack = SLACK * (1 + d + of.high)
                low, high = d - limit[:, None] - slack, d + limit[:, None] + slack
                i, at = np.nonzero((low <= of.high) & (high >= of.low))
                start, stop = ring_of(of, at, np.maximum(low[i, at], of.low[at])), ring_of(of, at, np.minimum(high[i, at], of.high[at]))
                each = stop - start + 1
                ring = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(start, each)
                i, at = np.repeat(i, each), np.repeat(at, each)
                new = (at != home[i]) | (ring != at_home[i])
                i, at, ring = i[new], at[new], ring[new]
                yield pa.RecordBatch.from_arrays([_vectors(q[i]), pa.array(at.astype(np.int32)), pa.array(ring.astype(np.int32)), pa.array(limit[i])], ["v", "list", "ring", "most"])

    asked = pin(vectors.select("v").where("v is not null").distinct())
    kinds = "v array<double>, list int, ring int, most double"
    home = pin(asked.mapInArrow(lambda b: visited(b, False), kinds))
    first = home.count()
    near = pin(_first(_visit(index, home, first), index.k, first * index.k))
    full = near.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("dist")).alias("d"))  # k numbers each
    bound = full.where(F.col("n") >= k).select("v", F.get("d", F.lit(k - 1)).alias("reached"))
    bounded = asked.join(bound, "v", "left").withColumn("reached", F.coalesce("reached", F.lit(float("inf"))))
    rest = pin(bounded.mapInArrow(lambda b: visited(b, True), kinds))
    later = rest.count()
    # At most: beyond the distance already reached nothing is handed on.
    return _first(near.unionByName(_visit(index, rest, later)), k, (first + later) * index.k)


def weighted(found: DataFrame, weights: str) -> DataFrame:
    """(v, y_pred) from neighbours; with ``distance`` an exact match outweighs everything else."""
    if weights not in ("distance", "uniform"):
        raise ValueError(f"unknown weights {weights!r}")
    if weights == "uniform":
        return found.groupBy("v").agg(F.avg("label").alias("y_pred"))
    near = F.when(F.col("dist") > 0, 1 / F.col("dist"))
    exact = F.avg(F.when(F.col("dist") == 0, F.col("label")))
    return found.groupBy("v").agg(F.coalesce(exact, F.sum(F.col("label") * near) / F.sum(near)).alias("y_pred"))


def indexed_predictions(index: NeighbourIndex | None, df: DataFrame, features: Sequence[str], k: int, weights: str, out: str) -> DataFrame:
    """``df`` with a prediction column, null where a feature is missing or nothing is labelled."""
    if index is None:
        return df.withColumn(out, F.lit(None).cast("double"))
    asked = df.withColumn("_asked", vector(features))
    found = weighted(search(index, asked.select(F.col("_asked").alias("v")), k), weights)
    joined = asked.drop(out).join(found.select(F.col("v").alias("_asked"), F.col("y_pred").alias(out)), "_asked", "left")
    return joined.drop("_asked")
