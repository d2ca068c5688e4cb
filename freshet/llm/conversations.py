"""Conversations as ordered turns, and digests over ordered pieces that no task has to hold.

Turns are ordered by ``turn`` (null first); equal turns by the SHA-256 of role and text. A null role or
text is empty. Repeated rows stay separate turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A conversation above this share of all turns is cut into slices.
SLICES = 64
#: Bytes that one row of a chain carries.
CHAIN_BYTES = 1 << 20


def turn_key() -> Column:
    """SHA-256 of role and text: tells turns apart and orders those of equal ``turn``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def order_number() -> Column:
    """``turn`` with null in front of every number."""
    return F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63)))


def chained_sha256(pieces: DataFrame, keys: Sequence[str], order: Sequence[str], piece: str, separator: bytes = b"") -> DataFrame:
    """(keys, sha256 hex) of each group's ``piece`` values joined in ``order``.

    Rows are dealt by ranges of keys and order, so a hot group lies in many tasks, each of which joins its
    share to rows of about a megabyte. Only those rows meet by key, and they are hashed one after another.
    """
    names = list(keys)
    own = pieces.select(*names, *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(piece).cast("binary").alias("_piece"))
    by = [*names, *[f"_o{i}" for i in range(len(order))]]
    types = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, key, held, size, rows = TaskContext.get().partitionId(), 0, None, [], 0, []
        for batch in batches:
            data = batch.to_pydict()
            for *now, value in zip(*[data[k] for k in names], data["_piece"]):
                if key != now or size >= CHAIN_BYTES:
                    if held:
                        rows.append((*key, part, number, separator.join(held)))
                        number += 1
                    key, held, size = now, [], 0
                held.append(value or b"")
                size += len(held[-1]) + len(separator)
                if len(rows) >= 1000 or sum(len(r[-1]) for r in rows[-4:]) > 2 * CHAIN_BYTES:
                    yield _batch(rows, chain)
                    rows = []
        if held:
            rows.append((*key, part, number, separator.join(held)))
        if rows:
            yield _batch(rows, chain)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows = None, None, []
        for batch in batches:
            data = batch.to_pydict()
            for *now, value in zip(*[data[k] for k in names], data["_chunk"]):
                if key == now:
                    state.update(separator)
                else:
                    if state is not None:
                        rows.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256()
                state.update(value)
            if len(rows) >= 1000:
                yield _batch(rows, final)
                rows = []
        if state is not None:
            rows.append((*key, state.hexdigest()))
        if rows:
            yield _batch(rows, final)

    chain, final = [*names, "_part", "_number", "_chunk"], [*names, "sha256"]
    chunks = own.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(join, f"{types}, _part int, _number int, _chunk binary")
    return chunks.repartition(*names).sortWithinPartitions(*names, "_part", "_number").mapInArrow(digest, f"{types}, sha256 string")


def _batch(rows: list[tuple], names: Sequence[str]) -> pa.RecordBatch:
    """Rows of plain values as a batch; ids are long, numbers of parts int."""
    kinds = {"_part": pa.int32(), "_number": pa.int32(), "_chunk": pa.binary(), "sha256": pa.string()}
    columns = [pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*rows))]
    return pa.RecordBatch.from_arrays(columns, list(names))
