"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of depth ``ORDER``, held as the counts of its paths: a context of up to
three bytes and the byte that followed. A byte costs -log2 of its share in the longest context that has
seen it, times the escape shares of the longer contexts that have not (method C: as many escapes as
distinct followers). The statistics are frozen after training, so a text's code length is an exact sum
over its bytes. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import byte_chunks, column_of, free_name

ORDER = 3
UNKNOWN = "und"
#: Most labelled rows that train one language, chosen by a hash of their text.
ROWS_PER_LANGUAGE = 4000
#: Bits of evidence per byte are multiplied by this before they become a share.
SHARPNESS = 4.0

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[9, 13, 32]] = 10  # all blanks are one byte


def windows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the three before it in its own text, as one 32-bit number (line ends before the start)."""
    folded = _LOWER[data]
    out = folded.copy()
    position = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets)) if len(data) else np.zeros(0, np.int64)
    for back in range(1, ORDER + 1):
        before = np.full(len(folded), 10, np.uint32)
        if len(folded) > back:
            before[back:] = np.where(position[back:] >= back, folded[:-back], np.uint32(10))
        out |= before << np.uint32(8 * back)
    return out


@dataclass
class Tree:
    """Paths of one language by context length: sorted keys and their costs, and the costs of escaping."""

    paths: list[tuple[np.ndarray, np.ndarray]]
    escapes: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, grams: np.ndarray, counts: np.ndarray) -> "Tree":
        paths, escapes = [], []
        for order in range(ORDER + 1):
            low = grams & np.uint32((1 << (8 * (order + 1))) - 1)
            keys, at = np.unique(low, return_inverse=True)
            seen = np.bincount(at, counts)
            contexts, of = np.unique(keys >> np.uint32(8), return_inverse=True)
            total, distinct = np.bincount(of, seen), np.bincount(of)
            paths.append((keys, np.log2((total + distinct)[of] / seen)))
            escapes.append((contexts, np.log2((total + distinct) / distinct)))
        return cls(paths, escapes)

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each window."""
        bits, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
        for order in range(ORDER, -1, -1):
            keys, costs = self.paths[order]
            low = grams & np.uint32((1 << (8 * (order + 1))) - 1)
            at = np.minimum(np.searchsorted(keys, low), len(keys) - 1)
            hit = open_ & (keys[at] == low)
            bits[hit] += costs[at[hit]]
            open_ &= ~hit
            contexts, leave = self.escapes[order]
            at = np.minimum(np.searchsorted(contexts, low >> np.uint32(8)), len(contexts) - 1)
            known = open_ & (contexts[at] == low >> np.uint32(8))
            bits[known] += leave[at[known]]
        return bits + 8 * open_


@dataclass
class LanguageModel:
    names: list[str]
    trees: list[Tree]

    def bits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Code length of each text under each language, and its bytes."""
        out, sizes = np.zeros((len(texts), len(self.trees))), np.zeros(len(texts))
        for first, data, offsets in byte_chunks(texts):
            rows = slice(first, first + len(offsets) - 1)
            sizes[rows] = np.diff(offsets)
            if not len(data):
                continue
            distinct, at = np.unique(windows(data, offsets), return_inverse=True)
            for k, tree in enumerate(self.trees):
                total = np.concatenate(([0.0], np.cumsum(tree.cost(distinct)[at])))
                out[rows, k] = total[offsets[1:]] - total[offsets[:-1]]
        return out, sizes


def shares(bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Share of each language by the mean evidence per byte."""
    rate = bits / np.maximum(sizes, 1)[:, None]
    weight = np.exp2(-SHARPNESS * (rate - rate.min(axis=1, keepdims=True)))
    return weight / weight.sum(axis=1, keepdims=True)


def held_out() -> Column:
    """Whether a row's doc_id puts it aside for measuring; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def learnable(docs: DataFrame) -> DataFrame:
    """Rows that may teach: known language, a text with letters, and not held out."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> LanguageModel:
    """Count paths over at most about ``rows_per_language`` labelled rows of each language.

    Rows are chosen by a hash of doc_id and text against a share, so the choice is the same on any cluster.
    What reaches the driver is bounded by the rows of the sample.
    """
    rows = learnable(docs.select("doc_id", "text", "lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel([], [])
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, rows_per_language / n)))))
    uniform = (F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 40) - 1))) / F.lit(float(1 << 40))
    sample = rows.where(uniform < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(column_of(batch, "lang").to_pylist(), object)
            for lang in sorted(set(langs.tolist())):
                texts = column_of(batch, "text").filter(pa.array(langs == lang))
                for _, data, offsets in byte_chunks(texts):
                    grams, n = np.unique(windows(data, offsets), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams)), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
                    )

    paths = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = paths.toArrow().to_pandas()
    names = sorted(table["lang"].unique())
    trees = []
    for name in names:
        own = table[table["lang"] == name]
        trees.append(Tree.of(own["gram"].to_numpy().astype(np.uint32), own["n"].to_numpy().astype(np.float64)))
    return LanguageModel(names, trees)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score, bits_per_byte.

    ``score`` is the share of the chosen language among all, from the mean evidence per byte. A text that is
    null or has no letters is ``und`` with score 0; so is every text if nothing could be learned. Equal
    codes go to the name that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = shared.value
        for batch in batches:
            letters = np.array(column_of(batch, "letters").to_pylist(), bool)
            names, scores, rates = np.full(len(letters), UNKNOWN, object), np.zeros(len(letters)), np.full(len(letters), np.nan)
            if trained.trees and letters.any():
                bits, sizes = trained.bits(column_of(batch, "text"))
                bits, sizes = bits[letters], sizes[letters]
                best = bits.argmin(axis=1)
                names[letters] = np.array(trained.names, object)[best]
                scores[letters] = shares(bits, sizes).max(axis=1)
                rates[letters] = bits.min(axis=1) / sizes
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), pa.array(names, pa.string()), pa.array(scores), pa.array(rates, from_pandas=True)],
                ["doc_id", "lang_pred", "score", "bits_per_byte"],
            )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letters).mapInArrow(
        work, "doc_id long, lang_pred string, score double, bits_per_byte double"
    )


#: Codes longer than this many times what nearly all labelled texts of the language need are not that language.
#: A text of few bytes may exceed that by a fixed number of bits.
RATE_QUANTILE, RATE_RATIO, RATE_SLACK_BITS = 0.999, 2.0, 64.0


def rate_limits(docs: DataFrame, model: LanguageModel) -> dict[str, float]:
    """Greatest bits per byte that passes for each language, from all labelled rows: a histogram in thousandths of a bit."""
    rows = identify(learnable(docs), model).where("bits_per_byte is not null")
    steps = rows.groupBy("lang_pred", F.floor(F.col("bits_per_byte") * 1000).alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    limits = {}
    for name in model.names:
        own = sorted((r["step"], r["n"]) for r in steps if r["lang_pred"] == name)
        total = np.cumsum([n for _, n in own])
        if len(total):
            limits[name] = RATE_RATIO * (own[int(np.searchsorted(total, RATE_QUANTILE * total[-1]))][0] + 1) / 1000
    return limits


def keep_known(docs: DataFrame, model: LanguageModel, min_score: float = 0.0, limits: dict[str, float] | None = None) -> DataFrame:
    """The rows and columns of ``docs`` whose text is written in a learned language.

    The language is that of the shortest code; the text is of it if its share is at least ``min_score`` and its code
    does not exceed the language's limit. Null texts and texts without letters go. Without anything learned, every text with letters stays.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    flag = free_name(docs, "_letters")
    most = np.array([(limits or {}).get(n, np.inf) for n in model.names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = shared.value
        for batch in batches:
            keep = np.array(column_of(batch, flag).to_pylist(), bool)
            if trained.trees and keep.any():
                bits, sizes = trained.bits(column_of(batch, "text"))
                keep &= shares(bits, sizes).max(axis=1) >= min_score
                keep &= bits.min(axis=1) <= most[bits.argmin(axis=1)] * sizes + RATE_SLACK_BITS
            index = batch.schema.get_field_index(flag)
            kept = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [c for i, c in enumerate(kept.columns) if i != index], [n for i, n in enumerate(kept.schema.names) if i != index]
            )

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(flag, letters).mapInArrow(work, docs.schema)
