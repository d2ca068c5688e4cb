"""Substring deduplication by hashing sentence-like units of lines.

Lines are cut at sentence ends, units are normalised and hashed, digests are grouped over the corpus, and
of every repeated unit the earliest occurrence stays. What is removed are runs of neighbouring repeated
units of at least ``MIN_RUN_WORDS`` words, so a passage is found wherever it begins inside a line, while a
short phrase that many texts share is left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import column_of
from freshet.runtime import pin

#: Units with fewer words are passed over: they neither make nor break a run.
MIN_UNIT_WORDS = 3
#: Least words of a run of repeated units. A passage of 50 words keeps about so many when the broken
#: sentences at its ends are taken off.
MIN_RUN_WORDS = 30

_UNIT = re.compile(r"[^.!?\n]+[.!?]*")


def units_of(text: str) -> list[tuple[int, int, int, int, bytes]]:
    """(number, start, end, words, digest) of every unit with enough words; offsets in code points of the text."""
    out = []
    for m in _UNIT.finditer(text):
        raw = m[0]
        words = raw.lower().rstrip(".!? ").split()
        if len(words) >= MIN_UNIT_WORDS:
            start = m.start() + len(raw) - len(raw.lstrip())
            digest = hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()
            out.append((len(out), start, m.end(), len(words), digest))
    return out


def text_key() -> Column:
    """With doc_id, what tells documents apart: rows may share a doc_id, or have none, and differ in their texts."""
    return F.unhex(F.substring(F.md5(F.encode("text", "UTF-8")), 1, 16))


def units(docs: DataFrame) -> DataFrame:
    """All units of all texts: doc_id, text_key, unit, start, end, words, digest. Null and empty texts have none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        names = ["doc_id", "text_key", "unit", "start", "end", "words", "digest"]
        for batch in batches:
            rows: list[tuple] = []
            for doc, key, text in zip(*(column_of(batch, c).to_pylist() for c in ("doc_id", "text_key", "text"))):
                if text:
                    rows += [(doc, key, *u) for u in units_of(text)]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").mapInArrow(
        work, "doc_id long, text_key binary, unit int, start int, end int, words int, digest binary"
    )


def find(docs: DataFrame, min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """Units to remove: doc_id, start, end, words, first_doc_id, first_start, run_start, run_words.

    Occurrences are ranked by (doc_id, hash of the text, start); the first of each digest stays. Rows that repeat
    a doc_id with the same text are one document, different texts under one doc_id, or without one, are documents
    of their own. A null doc_id ranks before all. Empty tables give an empty result.
    Digests are grouped with map-side minima and joined back, so a unit that is everywhere is no hot group.
    """
    return _found(docs, min_run_words).drop("text_key")


def _found(docs: DataFrame, min_run_words: int) -> DataFrame:
    all_units = pin(units(docs))
    rank = F.struct("doc_id", "text_key", "start")
    firsts = all_units.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("not (first <=> last)").drop("last")
    later = all_units.join(firsts, "digest").where(rank > F.col("first")).dropDuplicates(["doc_id", "text_key", "start", "digest"])
    in_doc = Window.partitionBy("doc_id", "text_key").orderBy("start")
    broken = F.coalesce((F.col("unit") - F.lag("unit").over(in_doc) > 1).cast("int"), F.lit(1))
    runs = later.withColumn("_new", broken).withColumn("_run", F.sum("_new").over(in_doc))
    run = Window.partitionBy("doc_id", "text_key", "_run")
    return (
        runs.withColumn("run_words", F.sum("words").over(run)).withColumn("run_start", F.min("start").over(run))
        .where(F.col("run_words") >= min_run_words)
        .select(
            "doc_id", "text_key", "start", "end", "words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"),
            "run_start", F.col("run_words").cast("long").alias("run_words"),
        )
    )


def remove(docs: DataFrame, min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """Texts without the repeated units: doc_id, text, and the removed [start, end) pairs of the original."""
    cuts = _found(docs, min_run_words).groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts")
    )

    def keep(text, cut):
        state = F.aggregate(
            cut, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda s, c: F.struct(
                c["end"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, c["start"] - s["at"])).alias("out")
            ),
        )
        return F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))

    keyed = docs.select("doc_id", "text", text_key().alias("_own"))
    joined = keyed.join(cuts, keyed["doc_id"].eqNullSafe(cuts["_doc"]) & (keyed["_own"] == cuts["_key"]), "left")
    return joined.select(
        "doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(keep(F.col("text"), F.col("cuts"))).alias("text"), "cuts"
    )
