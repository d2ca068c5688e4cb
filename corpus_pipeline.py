"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and all but the last
return the columns of documents. Null texts and texts without letters leave in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.llm import decontaminate, language, neardup, packing, pii
from freshet.llm.common import free_name, prepare, spread_rank
from freshet.runtime import pin

#: Near duplicates: words of a shingle, and percent of common shingles.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no learned language codes about as shortly as its own labelled texts."""
    prepare(spark)
    model = language.fit(docs)
    return language.keep_known(docs, model, limits=language.rate_limits(docs, model))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of every group of near duplicates.

    Equal rows are one document. Different texts under one doc_id are documents of their own: they are compared
    under numbers above all ids, and stay unless an alike text with a real or lower number does. Rows without a
    doc_id stay.
    """
    prepare(spark)
    number = free_name(docs, "_number")
    known = docs.where("doc_id is not null")
    # Written, so that its true size decides the join: usually it is empty and no text moves.
    shared = pin(known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id"))
    single = known.join(shared, "doc_id", "left_anti").select(*docs.columns, F.col("doc_id").cast("long").alias(number))
    # Few rows at most: those that share their doc_id. Equal texts of one doc_id leave one row.
    several = pin(known.join(shared, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))
    above = docs.agg(F.max("doc_id")).first()[0]
    several = spread_rank(several, [], ["doc_id", "text"], number).withColumn(number, F.col(number) + 1 + (above or 0))
    rows = single.union(several.select(*single.columns))
    found = neardup.near_duplicates(rows.select(F.col(number).alias("doc_id"), "text"), SHINGLE_WORDS, SIMILAR_PERCENT)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias(number)).distinct()
    return rows.join(gone, number, "left_anti").select(*docs.columns).union(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a copy of a benchmark item, also rows without a doc_id."""
    prepare(spark)
    found = decontaminate.rows_with_copies(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_gone_text")).distinct()
    names = free_name(docs, "_id"), free_name(docs, "_text")
    keyed = docs.select("*", *(c.alias(n) for c, n in zip(decontaminate.row_key(), names)))
    same = keyed[names[0]].eqNullSafe(gone["_gone"]) & (keyed[names[1]] == gone["_gone_text"])
    return keyed.join(gone, same, "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind."""
    prepare(spark)
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Not expressible in SQL (language model, tokenizer); tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
