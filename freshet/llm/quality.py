"""Quality by an interpolated modified Kneser-Ney model over characters, trained on trusted text.

The model is over characters as they are: an n-gram is ORDER code points, of any script, and none are folded together.
Its n-grams are not bounded, so they stay in Spark: counts, continuation counts and contexts are grouped there, and each
distinct n-gram of the texts gets its probability by joins. Texts are cut into blocks, which send only their distinct
n-grams to those joins and meet the costs by their number, so what is shuffled is far less than a row a character.

What the characters leave over falls back, as the last of the interpolated models, on one over classes of characters (small
letters, capitals, digits, blanks, each ASCII mark, other letters, other signs) times each code point's share of its class,
instead of on one number for all of Unicode. Its n-grams are bounded by SYMBOLS**ORDER whatever the corpus, and only they
go to the workers whole. Texts above their language's quantile of trusted perplexities are dropped.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from freshet.llm.common import column_of
from freshet.runtime import in_parallel, pin

ORDER = 4
#: Start, 26 small letters, capital, digit, blank, line end, 32 ASCII marks, other letter, other sign.
SYMBOLS = 65
CODE_POINTS = 0x110000
#: Bits of a code point plus one in a context; 0 stands before a text.
BITS = 21
_MASK = (1 << BITS) - 1
#: Alphabets up to this have n-gram numbers below 2**63.
LARGEST = 55_000
#: Bytes of text of a block, unless a single text has more.
BLOCK_BYTES = 4 << 20
#: Bits of the table that spares most texts without a trusted label a shuffle (8 MB).
MARKS = 1 << 26
#: Share of trusted texts of a language that its threshold lets pass, and the slack above it.
QUANTILE, SLACK = 0.99, 1.25
#: Accuracy of the mergeable quantile sketch.
ACCURACY = 10_000


def _symbol_table() -> np.ndarray:
    """Class of every code point."""
    table = np.full(CODE_POINTS, 63, np.int32)  # other letters
    kinds = [unicodedata.category(chr(c)) for c in range(0x3000, CODE_POINTS)]
    table[0x3000:] = [63 if k[0] in "LM" else 29 if k == "Zs" else 64 for k in kinds]
    table[:128] = 64
    table[0x80:0xC0] = 64
    table[[0xAA, 0xB5, 0xBA]] = 63
    table[[0xD7, 0xF7]] = 64
    table[0x2000:0x2C00] = 64
    table[97:123] = np.arange(1, 27)
    table[65:91] = 27
    table[48:58] = 28
    table[[32, 9, 0xA0]] = 29
    table[[10, 11, 12, 13]] = 30
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    table[marks] = np.arange(31, 31 + len(marks))
    return table


_TABLE = _symbol_table()


def code_points(texts: list[str]) -> np.ndarray:
    """Code points of all texts one after the other."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts one after the other, and the offsets of the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    return _TABLE[code_points(texts)], np.concatenate(([0], np.cumsum(sizes)))


def character_grams(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The n-gram that ends at each character: (context, character), and the offsets of the texts.

    Characters count from one; a context has BITS for each, the nearest lowest.
    """
    own = code_points(texts).astype(np.int64) + 1
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    place = np.arange(len(own)) - np.repeat(offsets[:-1], np.diff(offsets))
    context = np.zeros(len(own), np.int64)
    for back in range(1, order):
        context[back:] |= np.where(place[back:] >= back, own[:-back], 0) << BITS * (back - 1)
    return context, own, offsets


def _letters(context: np.ndarray, own: np.ndarray, order: int) -> Iterator[np.ndarray]:
    for back in range(1, order):
        yield context >> BITS * (back - 1) & _MASK
    yield own


def _numbered(context: np.ndarray, own: np.ndarray, order: int) -> Iterator[tuple[slice, np.ndarray, Callable]]:
    """Slices of the n-grams whose alphabet is small enough, their letters, and a function that numbers n-grams of these letters."""
    todo = [slice(0, len(own))] if len(own) else []
    while todo:
        part = todo.pop()
        present = np.zeros(1 << BITS, bool)
        for x in _letters(context[part], own[part], order):
            present[x] = True
        letters = np.flatnonzero(present)
        if len(letters) > LARGEST:  # so many letters need as many n-grams, so halves end
            middle = (part.start + part.stop) // 2
            todo += [slice(middle, part.stop), slice(part.start, middle)]
            continue
        ranks = np.where(present, np.cumsum(present) - 1, -1).astype(np.int32)

        def number(c: np.ndarray, o: np.ndarray, sure: bool = True, ranks: np.ndarray = ranks, size: int = len(letters)) -> np.ndarray:
            """In base ``size``; unless ``sure``, -1 for what has other letters."""
            code = ranks[o].astype(np.int64)
            known = None if sure else code >= 0
            for back in range(1, order):
                rank = ranks[c >> BITS * (back - 1) & _MASK]
                code += np.multiply(rank, size**back, dtype=np.int64)
                if not sure:
                    known &= rank >= 0
            return code if sure else np.where(known, code, -1)

        yield part, letters, number


def distinct_grams(context: np.ndarray, own: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams and how often each is there; where an alphabet is too large, some more than once."""
    found = []
    for part, letters, number in _numbered(context, own, order):
        code, n = np.unique(number(context[part], own[part]), return_counts=True)
        c, rest = np.zeros(len(code), np.int64), code // len(letters)
        for back in range(1, order):
            c |= letters[rest % len(letters)] << BITS * (back - 1)
            rest //= len(letters)
        found.append((c, letters[code % len(letters)], n))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def look_up(context: np.ndarray, own: np.ndarray, order: int, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The cost of each n-gram from a table (contexts, characters, costs) that must hold them all."""
    out = np.zeros(len(own), known[2].dtype)
    for part, _, number in _numbered(context, own, order):
        codes, (wanted, back) = number(known[0], known[1], sure=False), np.unique(number(context[part], own[part]), return_inverse=True)
        by_code = np.argsort(codes)
        codes = codes[by_code]
        at = np.searchsorted(codes, wanted)
        if at[-1] == len(codes) or (codes[at] != wanted).any():
            raise RuntimeError("an n-gram has no cost; the texts are not the same when they are read again")
        out[part] = known[2][by_code[at]][back]
    return out


def _in_parts(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= limit or i == len(texts) - 1:
            yield first, [t or "" for t in texts[first : i + 1]]
            first, size = i + 1, 0


def gram_counts(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """Counts of all n-grams of the highest order: (context, own, n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _in_parts(column_of(batch, "text").to_pylist()):
                context, own, _ = character_grams(part, order)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in distinct_grams(context, own, order)], ["context", "own", "n"])

    return texts.select("text").mapInArrow(count, "context long, own long, n long").groupBy("context", "own").agg(F.sum("n").alias("n"))


def _class_numbers(context: np.ndarray, own: np.ndarray, order: int) -> np.ndarray:
    """N-grams of classes as numbers in base SYMBOLS."""
    classes = np.concatenate(([0], _TABLE))
    code = classes[own].astype(np.int64)
    for back in range(1, order):
        code += classes[context >> BITS * (back - 1) & _MASK].astype(np.int64) * SYMBOLS**back
    return code


def class_counts(counts: DataFrame, order: int) -> DataFrame:
    """The same n-grams with classes for characters: (gram, n)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, own, n = (column_of(batch, c).to_numpy() for c in ("context", "own", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(_class_numbers(context, own, order)), pa.array(n)], ["gram", "n"])

    return counts.mapInArrow(fold, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified discounts for counts of one, two, and three or more, from the counts of counts."""
    row = counts.agg(*(F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = ((row[f"n{k}"] or 0) for k in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), 0.95 + k) for k, d in enumerate(raw))


def _discount(counts: DataFrame) -> Column:
    d1, d2, d3 = _discounts(counts)
    return F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)


def smoothed(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For one order of classes: (gram, alpha), the discounted share in its context, and (context, gamma), what is left."""
    own = counts.select("gram", "n", (F.col("gram") / SYMBOLS).cast("long").alias("context"), _discount(counts).alias("d"))
    contexts = own.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("taken"))
    alpha = own.join(contexts, "context").select("gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("alpha"))
    return alpha, contexts.select("context", (F.col("taken") / F.col("total")).alias("gamma"))


@dataclass
class CharacterModel:
    """Of the classes, sparse tables of every order from 1 up: (grams, alphas, contexts, gammas), and the characters: (code points, counts).

    Of the characters as they are, from order 1 up, tables in Spark: (context, own, share) of the n-grams, their discounted
    share in their context, and (context, left), what that leaves.
    """

    orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    characters: tuple[np.ndarray, np.ndarray]
    exact: list[tuple[DataFrame, DataFrame]] = field(default_factory=list)

    def dense(self) -> np.ndarray:
        """-log2 of the probability of every n-gram's last character, by n-gram number."""
        p = np.full(1, 1 / SYMBOLS, np.float32).repeat(SYMBOLS)
        for k, (grams, alphas, contexts, gammas) in enumerate(self.orders):
            gamma = np.ones(SYMBOLS**k, np.float32)
            gamma[contexts] = gammas
            middle = SYMBOLS ** max(0, k - 1)  # the characters that a context shares with the shorter n-gram
            p = (gamma.reshape(-1, middle, 1) * p.reshape(1, middle, SYMBOLS)).reshape(-1)
            p[grams] += alphas.astype(np.float32)
        return -np.log2(p)

    def own(self) -> np.ndarray:
        """-log2 of the probability of every code point within its class.

        Counts are discounted; what that leaves of a class goes to all its code points alike.
        """
        points, counts = self.characters
        n = np.zeros(CODE_POINTS)
        n[points] = counts
        once, twice = (n == 1).sum(), (n == 2).sum()
        d = min(max(once / (once + 2 * twice), 0.05), 0.95) if once and twice else 0.5
        size = np.bincount(_TABLE, minlength=SYMBOLS)
        total, kinds = np.bincount(_TABLE, n, SYMBOLS), np.bincount(_TABLE, n > 0, SYMBOLS)
        left = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0) / np.maximum(size, 1)
        return -np.log2(np.maximum(n - d, 0) / np.maximum(total, 1)[_TABLE] + left[_TABLE]).astype(np.float32)


def fit(trusted: DataFrame, order: int = ORDER) -> CharacterModel:
    """Model from all trusted texts (a column ``text``). Lower orders count how many characters, or classes, precede.

    The tables brought to the driver hold at most SYMBOLS**ORDER entries (observed n-grams of classes only) and CODE_POINTS characters.
    """
    counted = pin(gram_counts(trusted, order))
    found = counted.groupBy("own").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    classes, exact = in_parallel([lambda: _class_tables(counted, order), lambda: _character_tables(counted, order)], 2)
    return CharacterModel(classes, (found["own"].to_numpy(np.int64) - 1, found["n"].to_numpy(np.int64)), exact)


def _class_tables(counted: DataFrame, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    counts = pin(class_counts(counted, order))
    tables = []
    for k in range(order, 0, -1):
        alpha, gamma = smoothed(counts)
        a, g = alpha.toArrow().to_pandas(), gamma.toArrow().to_pandas()
        tables.append(tuple(x.to_numpy() for x in (a["gram"], a["alpha"], g["context"], g["gamma"])))
        if k > 1:  # continuation counts: distinct characters before each shorter n-gram
            counts = pin(counts.select((F.col("gram") % SYMBOLS ** (k - 1)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    return tables[::-1]


def _character_tables(counts: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame]]:
    tables = []
    for k in range(order, 0, -1):
        each = counts.select("context", "own", "n", _discount(counts).alias("d"))
        contexts = each.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("taken"))
        # At order 1 there is one context and at order 2 at most one a code point.
        near = F.broadcast(contexts) if k <= 2 else contexts
        share = each.join(near, "context").select("context", "own", ((F.col("n") - F.col("d")) / F.col("total")).alias("share"))
        tables.append((share, contexts.select("context", (F.col("taken") / F.col("total")).alias("left"))))
        if k > 1:
            counts = pin(counts.groupBy(F.col("context").bitwiseAND(_reach(k - 1)).alias("context"), "own").agg(F.count(F.lit(1)).alias("n")))
    return tables[::-1]


def _reach(order: int) -> int:
    """Bits of the context of an n-gram of that order."""
    return (1 << BITS * (order - 1)) - 1


_dense: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def gram_costs(grams: DataFrame, model: CharacterModel) -> DataFrame:
    """(context, own, cost) of distinct n-grams: -log2 of the probability of their character.

    Interpolated from the longest context to none: ``share`` adds up, ``left`` is what falls to the classes at the end.
    """
    shared = grams.sparkSession.sparkContext.broadcast(CharacterModel(model.orders, model.characters))
    key = f"{grams.sparkSession.sparkContext.applicationId}-{shared._jbroadcast.id()}"
    order = len(model.orders)
    out = grams.select("context", "own", F.lit(0.0).alias("p"), F.lit(1.0).alias("rest"))
    for k in range(order, 0, -1):
        share, left = (t.withColumnRenamed("context", "_context") for t in model.exact[k - 1])
        share = share.withColumnRenamed("own", "_own")
        near = out["context"].bitwiseAND(_reach(k))
        # One row a code point at most: shares of order 1, what contexts leave up to order 2.
        out = out.join(F.broadcast(share) if k == 1 else share, (near == F.col("_context")) & (out["own"] == F.col("_own")), "left")
        out = out.select("context", "own", (F.col("p") + F.col("rest") * F.coalesce("share", F.lit(0.0))).alias("p"), "rest")
        near = out["context"].bitwiseAND(_reach(k))
        out = out.join(F.broadcast(left) if k <= 2 else left, near == F.col("_context"), "left")
        out = out.select("context", "own", "p", (F.col("rest") * F.coalesce("left", F.lit(1.0))).alias("rest"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _dense:
            _dense.clear()
            _dense[key] = shared.value.dense(), shared.value.own()
        cost, alone = _dense[key]
        for batch in batches:
            context, own, p, rest = (column_of(batch, c).to_numpy() for c in ("context", "own", "p", "rest"))
            base = np.exp2(-(cost[_class_numbers(context, own, order)] + alone[own - 1]).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(context), pa.array(own), pa.array(-np.log2(p + rest * base))], ["context", "own", "cost"])

    return out.mapInArrow(work, "context long, own long, cost double")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, list[str]]]:
    """Rows in blocks of BLOCK_BYTES of text: number, the rows compressed, their texts. Equal rows give an equal number."""
    held: list[pa.RecordBatch] = []
    size = 0

    def block() -> tuple[int, bytes, list[str]]:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
            out.write_table(pa.Table.from_batches(held).combine_chunks())
        data = sink.getvalue().to_pybytes()
        number = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)
        return number, data, [t for b in held for t in column_of(b, "text").to_pylist()]

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(column_of(batch, "text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(ends, before + BLOCK_BYTES - size, "right")), first + (not held))
            if last > first:
                held.append(batch.slice(first, last - first))
                size += int(ends[last - 1] - before)
                first = last
            if first < batch.num_rows or size >= BLOCK_BYTES:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def perplexities(docs: DataFrame, model: CharacterModel) -> DataFrame:
    """All columns of ``docs`` but the text, and ``perplexity`` per character (null for an empty text)."""
    order = len(model.orders)
    others = [f.name for f in docs.schema.fields if f.name != "text"]

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts in _blocks(batches):
            parts = [distinct_grams(*character_grams(part, order)[:2], order)[:2] for _, part in _in_parts(texts)]
            context, own, _ = distinct_grams(*(np.concatenate(x) for x in zip(*parts)), order)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), number)), pa.array(context), pa.array(own)], ["block", "context", "own"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, data, _ in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.binary())], ["block", "rows"])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        known = tuple(right.column(c).to_numpy() for c in ("context", "own", "cost"))
        found = []
        for data in left.column("rows"):
            table = pa.ipc.open_stream(data.as_buffer()).read_all()
            out = np.full(table.num_rows, np.nan)
            for first, part in _in_parts(table.column("text").to_pylist()):
                context, own, offsets = character_grams(part, order)
                size = np.diff(offsets)
                some = size > 0
                if some.any():
                    total = np.add.reduceat(look_up(context, own, order, known), offsets[:-1][some])
                    out[first : first + len(part)][some] = np.exp2(total / size[some])
            found.append(table.select(others).append_column("perplexity", pa.array(out, from_pandas=True)))
        return pa.concat_tables(found) if found else schema_of.empty_table()

    schema = docs.select(*others).withColumn("perplexity", F.lit(None).cast("double")).schema
    schema_of = to_arrow_schema(schema)
    seen = pin(docs.mapInArrow(grams, "block long, context long, own long"))
    costs = gram_costs(seen.select("context", "own").distinct(), model)
    known = seen.join(costs, ["context", "own"]).select("block", "context", "own", "cost")
    blocks = docs.mapInArrow(rows, "block long, rows binary")
    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(work, schema)


def trusted_texts(docs: DataFrame, good: DataFrame) -> DataFrame:
    """Texts whose doc_id is among the distinct ``_good``. A table of MARKS bits leaves out most others before texts are shuffled."""
    slot = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(MARKS))
    marks = good.select(F.pmod(F.xxhash64(F.col("_good").cast("string")), F.lit(MARKS)).alias("slot"))
    marks = marks.groupBy(F.bitmap_bucket_number("slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_bits"))
    near = docs.select("doc_id", "text", slot.alias("_slot")).join(F.broadcast(marks), F.bitmap_bucket_number("_slot") == F.col("_bucket"))
    place = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    near = near.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(_slot) % 8 as int))")) != 0).select("doc_id", "text")
    # Merge join at every size: what is left is shuffled once, whatever the number of labels. A semi join would be moved
    # before the marks.
    return near.join(good.hint("merge"), near["doc_id"] == good["_good"]).select("doc_id", "text")


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """doc_id, lang, perplexity, threshold, kept for every document.

    Trusted texts are those labelled quality 1 and not toxic. ``kept``: the perplexity is at most ``slack``
    times the ``quantile`` of the trusted ones of its language (of all trusted ones where a language has
    none; a null language is one of its own). Empty and null texts have no perplexity and are not kept. Without any
    trusted text nothing can be judged and everything with a text is kept. Repeated rows each get a row.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("_good")).distinct()
    own = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    model = fit(trusted_texts(own, good))
    scored = pin(perplexities(own, model) if len(model.orders[0][0]) else own.select("doc_id", "lang", F.when(F.length("text") > 0, 1.0).alias("perplexity")))
    trusted = scored.join(good, scored["doc_id"] == good["_good"], "left_semi").where("perplexity is not null")
    cut = F.percentile_approx("perplexity", quantile, ACCURACY) * slack
    by_language = {r.lang: r.threshold for r in trusted.groupBy("lang").agg(cut.alias("threshold")).collect()}  # one row a language
    overall = trusted.agg(F.coalesce(cut, F.lit(float("inf"))).alias("threshold")).first().threshold
    known = F.create_map(*(F.lit(x) for pair in by_language.items() for x in pair)) if by_language else None
    return (
        scored.withColumn("threshold", F.lit(overall) if known is None else F.coalesce(known[F.col("lang")], F.lit(overall)))
        .select("doc_id", "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))
    )
