"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import byte_chunks, column_of, mix64, shingle_hashes, word_hashes

WORDS = 5  # words of a shingle
BIN_BITS = 8  # 256 bins
LOW_BITS = 4  # bits kept of each bin
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_MAX_PROBES = 1 << 13


def _probe(bins: np.ndarray, attempt: int, bin_bits: int) -> np.ndarray:
    """The bin that an empty bin asks at its n-th attempt: a fixed hash of both."""
    with np.errstate(over="ignore"):
        key = bins.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mix64(key) >> np.uint64(64 - bin_bits)).astype(np.int64)


def one_permutation(shingles: np.ndarray, offsets: np.ndarray, bin_bits: int = BIN_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Least hash in each of 2^bin_bits bins for each row, empty bins filled; and which rows have none at all.

    Each shingle is hashed once: the high bits choose the bin. An empty bin copies the bin that its own
    sequence of hashed probes first meets non-empty, so filled bins agree between two rows as often as
    full ones do, with the least variance.
    """
    rows, bins = len(offsets) - 1, 1 << bin_bits
    table = np.full(rows * bins, _EMPTY)
    if len(shingles):
        row = np.repeat(np.arange(rows), np.diff(offsets))
        np.minimum.at(table, row * bins + (shingles >> np.uint64(64 - bin_bits)).astype(np.int64), shingles)
    table = table.reshape(rows, bins)
    full = table != _EMPTY
    none = ~full.any(axis=1)
    at_row, at_bin = np.nonzero(~full & ~none[:, None])
    for attempt in range(1, _MAX_PROBES):
        if not len(at_row):
            break
        source = _probe(at_bin, attempt, bin_bits)
        found = full[at_row, source]
        table[at_row[found], at_bin[found]] = table[at_row[found], source[found]]
        at_row, at_bin = at_row[~found], at_bin[~found]
    for r, b in zip(at_row.tolist(), at_bin.tolist()):  # practically never: the next full bin
        there = np.flatnonzero(full[r])
        table[r, b] = table[r, there[np.searchsorted(there, b) % len(there)]]
    return table, none


def low_bits(texts: pa.Array, words: int = WORDS, bin_bits: int = BIN_BITS, bits: int = LOW_BITS) -> np.ndarray:
    """Low-order bits of every bin for every text, as rows of small numbers; -1 marks a text without words."""
    out = np.full((len(texts), 1 << bin_bits), -1, np.int16)
    for first, data, offsets in byte_chunks(texts):
        hashes, word_offsets = word_hashes(data, offsets)
        table, none = one_permutation(*shingle_hashes(hashes, word_offsets, words), bin_bits)
        part = (table & np.uint64((1 << bits) - 1)).astype(np.int16)
        part[none] = -1
        out[first : first + len(offsets) - 1] = part
    return out


def packed(low: np.ndarray, bits: int = LOW_BITS) -> list[str]:
    """Fingerprints as hex strings, ``bits`` bits a bin; empty for a text without words."""
    planes = (np.maximum(low, 0)[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1
    rows = np.packbits(planes.reshape(len(low), -1).astype(np.uint8), axis=1)
    return ["" if none else row.tobytes().hex() for row, none in zip(rows, low[:, 0] < 0)]


def likeness(a: np.ndarray, b: np.ndarray, bits: int = LOW_BITS) -> np.ndarray:
    """Estimated share of common shingles, row by row, with the chance agreement of low bits taken out.

    Two texts without words are alike (1), one such text and any other are not (0).
    """
    chance = 0.5**bits
    none_a, none_b = a[:, 0] < 0, b[:, 0] < 0
    share = ((a == b).mean(axis=1) - chance) / (1 - chance)
    return np.where(none_a | none_b, (none_a & none_b).astype(float), np.clip(share, 0.0, 1.0))


def edited_text(text: str, follower: str) -> str:
    """The last third of the code points replaced by as many first ones of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + follower[:cut]


def _dealt(docs: DataFrame) -> DataFrame:
    """Rows dealt to ranges of doc_id, each range with a copy of the row that follows its last one.

    Cut points come from a quantile sketch of the ids: one per shuffle partition. Each text is shuffled once.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    levels = [i / parts for i in range(1, parts)]
    marks = keyed.where("doc_id is not null").approxQuantile("_key", levels, 1 / (4 * parts)) if levels else []
    cuts = np.unique(np.array(marks, np.float64))

    def bucket(keys: np.ndarray) -> np.ndarray:
        return len(cuts) - np.searchsorted(cuts, keys.astype(np.float64), "right")

    @F.pandas_udf("int")
    def bucket_of(keys: pd.Series) -> pd.Series:
        return pd.Series(bucket(keys.to_numpy()).astype(np.int32))

    tops = {r.b: r.top for r in keyed.select("_key").groupBy(bucket_of("_key").alias("b")).agg(F.max("_key").alias("top")).collect()}
    order = sorted(tops)  # at most one per partition
    before = {b: order[i - 1] for i, b in enumerate(order)}

    @F.pandas_udf("array<struct<bucket:int,guest:boolean>>")
    def places(keys: pd.Series) -> pd.Series:
        values = keys.to_numpy()
        out = []
        for key, b in zip(values.tolist(), bucket(values).tolist()):
            own = [{"bucket": b, "guest": False}]
            out.append(own + [{"bucket": before[b], "guest": True}] if tops[b] == key else own)
        return pd.Series(out)

    return (
        keyed.withColumn("_at", F.explode(places("_key")))
        .select("doc_id", "_key", "text", F.col("_at.bucket").alias("bucket"), F.col("_at.guest").alias("guest"))
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "guest", F.desc("_key"), "text")
    )


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text and of its edited form, and both likenesses.

    The edited form takes its end from the next document in descending doc_id, the first after the last.
    A null text is empty: n_chars 0, fingerprint ''. Rows that share a doc_id follow each other by text;
    a null doc_id comes last. A lone document is its own follower. An empty table gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, waiting for its follower
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                low = low_bits(column_of(part, "text"))
                rows = list(zip(*(column_of(part, c).to_pylist() for c in ("doc_id", "text", "bucket", "guest")), low))
                if held:
                    rows.insert(0, held)
                pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[3]]
                held = rows[-1]
                if not pairs:
                    continue
                edited = [edited_text(a[1], b[1]) for a, b in pairs]
                own, after = np.array([a[4] for a, _ in pairs]), np.array([b[4] for _, b in pairs])
                changed = low_bits(pa.array(edited))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(packed(own)),
                        pa.array(packed(changed)), pa.array(likeness(own, changed)), pa.array(likeness(own, after)),
                    ],
                    ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return _dealt(docs).select("doc_id", "text", "bucket", "guest").mapInArrow(work, SCHEMA)
