"""Helpers shared by the text operators: intermediate tables, gapless ranks, components, word hashes.

Conventions of every operator here:

* It reads only the columns it names, so extra or clashing columns do no harm.
* A null text is treated like an empty one unless the operator says otherwise.
* Repeated rows (the same doc_id again) stay separate rows unless the operator says otherwise.
* Ties are broken by doc_id, then by the text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.runtime import pin, ship, unpin

#: Rows of one rank bucket; the number of buckets follows the input, so a task stays this small.
BUCKET_ROWS = 5_000
#: Bytes of text that the vectorised helpers take at once.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch where the session has not chosen another number: texts are long.
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Send the package to the workers and hand them texts in small batches, which bounds their memory."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """The intermediate tables of one call; ``last`` writes the result and deletes all others."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def pin(self, df: DataFrame) -> DataFrame:
        self.tables.append(pin(df))
        return self.tables[-1]

    def last(self, df: DataFrame) -> DataFrame:
        out = pin(df)
        for table in self.tables:
            unpin(table)
        self.tables.clear()
        return out


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread_rank(
    df: DataFrame, group: Sequence[str], order: Sequence[str], into: str = "rank", position: Column | None = None
) -> DataFrame:
    """Gapless rank from 0 inside each group, without bringing a group together in one task.

    Rows are dealt to buckets, the rank follows (bucket, order). Bucket counts give each bucket its offset,
    and only rows of one bucket of one group are sorted together. ``position`` in [0, 1) decides the bucket
    and must spread the rows; by default it is a hash of ``order``. ``df`` is read twice, so it should be a
    written table. Rows equal in ``order`` get different ranks.
    """
    buckets = max(1, -(-df.count() // BUCKET_ROWS))
    at = hash01(*order) if position is None else position
    with_bucket = df.withColumn("_bucket", F.floor(at * buckets))
    keys = [*group, "_bucket"]
    counts = with_bucket.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    return (
        with_bucket.join(offsets, keys)
        .withColumn(into, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_offset")
    )


def hash01(*columns: Column | str) -> Column:
    """A hash of the columns as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 12) / F.lit(float(1 << 52))


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """Components of the graph of ``edges (a, b)`` long: rows (node, component), component the least node.

    Alternating large-star and small-star steps: each hangs the neighbours of a node under the least of
    them, so every step is one grouped minimum and one join, hot nodes are pre-aggregated, and a chain of
    length n takes about log n rounds. Edges are written between rounds, so lineage stays short.
    """
    pairs = pin(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = pairs.union(pairs.select("b", "a"))
        # Written, so that Spark may split the edges of a hot node in the join that follows.
        least = pin(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.where("a <> b").distinct()
        lows = small.groupBy("a").agg(F.min("b").alias("m"))
        hung = small.join(lows, "a")
        old, pairs = pairs, pin(
            hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(hung.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct()
        )
        unpin(old)
        unpin(least)
        # Stars are reached when the edges no longer change.
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    low = pairs.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = low.select(F.col("component").alias("node"), "component").distinct()
    return low.union(roots).distinct()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32_utf8(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes."""
    return F.crc32(F.encode(text, "UTF-8"))


# --- vectorised words -------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on unsigned 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants fixed by the seed."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(steps + np.uint64(seed) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


_BYTE = constants(256, 1)
_PLACE = constants(4096, 2)
_GRAM = constants(64, 3)


def byte_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a string column as (first row, bytes, row offsets); a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), len(column))
        yield low, raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


#: Letters, digits and everything beyond ASCII: what plain words are made of once marks are left out.
PLAIN = np.zeros(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lowered) and each row's word offsets.

    ``inside`` says which bytes belong to words: by default all but ASCII white space.
    """
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = inside[data]
    begins = np.empty(len(data), bool)
    begins[0] = True
    np.logical_not(solid[:-1], out=begins[1:])
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(solid & begins)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    number = np.cumsum(solid & begins) - 1
    place = (np.arange(len(data)) - starts[np.maximum(number, 0)]) & 4095
    with np.errstate(over="ignore"):
        values = _BYTE[_LOWER[data]] * _PLACE[place]
        values[~solid] = 0
        words = mix64(np.add.reduceat(values, starts))
    return words, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in each row and their row offsets.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    counts = np.diff(offsets)
    shingles = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out = np.concatenate(([0], np.cumsum(shingles)))
    if out[-1] == 0:
        return np.zeros(0, np.uint64), out
    row = np.repeat(np.arange(len(counts)), shingles)
    at = np.arange(out[-1]) - out[row] + offsets[row]
    total = np.zeros(out[-1], np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            inside = at + j < offsets[row + 1]
            total += np.where(inside, words[np.minimum(at + j, len(words) - 1)], np.uint64(j + 1)) * _GRAM[j]
        return mix64(total), out


def hex_of(values: bytes) -> str:
    return values.hex()


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
