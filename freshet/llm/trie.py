"""Prefix trie of conversations, rolled up in bands of fixed height.

A node is a distinct sequence of first turns. It is told by a 128-bit digest: every (depth, turn) is hashed
and the hashes on the way are combined by exclusive or, so prefixes come from running windows, and a parent's
digest from its child's. Subtree totals need every ancestor of every node. Depths are cut into bands of
``BAND`` levels: a node is exploded only to its ancestors within its band, along the path of its smallest
conversation. The band roots then form a trie of their own, ``BAND`` times lower, which is rolled up in the
same way, and their completed totals are lifted to the ancestors in the band above. A trie of depth d thus
takes log d / log BAND rounds, and no node meets more than ``2 * BAND`` ancestors in a round.

Order of turns and nulls: see ``conversations``. Rows without a conv_id belong to no conversation and are left
out. Repeated rows are turns of their own. An empty table has no nodes, not even a root. Further columns are
not read. Conversations that hold a large share of all turns are cut into slices along their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import Scratch, prepare
from freshet.llm.conversations import SLICES, chained_sha256, order_number, turn_key
from freshet.operators.ordering import SLICE, plan_slices

#: Levels of a band.
BAND = 16
#: A conversation takes its first turns from the one with the next lower multiple of this.
SHARED_BY = 20
_UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
_BEFORE = (Window.unboundedPreceding, -1)
_EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _hashes(depth: Column, key: Column) -> tuple[Column, Column]:
    return F.xxhash64(depth, key), F.xxhash64(key, depth, F.lit("second"))


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _placed(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, object]:
    """conv_id, slice, pos from 1, key, words of every turn; and the plan of the slices."""
    text = F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), order_number().alias("_turn"), turn_key().alias("key"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    # Digests instead of texts from here on; planning reads them several times.
    rows = scratch.pin(rows)
    plan = plan_slices(rows, ["conv_id"], "_turn", least_slices=SLICES)
    if plan.needed:
        rows = plan.tag(rows)
        before = F.coalesce(F.get("_starts", F.col(SLICE)), F.lit(0))
    else:
        rows, before = rows.withColumn(SLICE, F.lit(0)), F.lit(0)
    inside = Window.partitionBy("conv_id", SLICE).orderBy("_turn", "key")
    placed = rows.select("conv_id", SLICE, (before + F.row_number().over(inside)).cast("long").alias("pos"), "key", "words")
    return scratch.pin(placed), plan


def _paths(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations as (c, d, a, b, pa, pb, words, last): node and parent digest at each depth; and (c, total)."""
    placed, plan = _placed(conversations, scratch)
    c = F.col("conv_id")
    ids = placed.groupBy("conv_id").agg(F.max("pos").alias("n")).select(
        c.alias("c"), "n", (c - c % SHARED_BY).alias("base"), (F.crc32(c.cast("string").cast("binary")) % 4).alias("h")
    )
    starts = placed.where("pos <= 3").select(c.alias("base"), "pos", "key", "words")
    lead = ids.join(starts, "base").where("pos <= h")
    x, y = _hashes(F.col("pos"), F.col("key"))
    so_far = Window.partitionBy("c").orderBy("pos").rowsBetween(*_UP_TO_HERE)
    lead = lead.select("c", F.col("pos").alias("d"), x.alias("x"), y.alias("y"), "words", F.bit_xor(x).over(so_far).alias("a"), F.bit_xor(y).over(so_far).alias("b"))
    taken = lead.groupBy("c").agg(F.count(F.lit(1)).alias("k"), F.bit_xor("x").alias("la"), F.bit_xor("y").alias("lb"))
    zero = F.lit(0).cast("long")
    ids = scratch.pin(ids.join(taken, "c", "left").select(
        "c", "h", *[F.coalesce(v, zero).alias(v) for v in ("k", "la", "lb")],
        (F.coalesce("k", zero) + F.greatest(F.col("n") - F.col("h"), zero)).alias("total"),
    ))
    known = ids.withColumnRenamed("c", "conv_id")
    own = (placed.join(plan.spread(known), ["conv_id", SLICE]) if plan.needed else placed.join(known, "conv_id")).where("pos > h")
    own = own.withColumn("d", F.col("k") + F.col("pos") - F.col("h"))
    x, y = _hashes(F.col("d"), F.col("key"))
    own = own.select("conv_id", SLICE, "d", "words", "total", "la", "lb", x.alias("x"), y.alias("y"))
    if plan.needed:
        earlier = Window.partitionBy("conv_id").orderBy(SLICE).rowsBetween(*_BEFORE)
        slices = own.groupBy("conv_id", SLICE).agg(F.bit_xor("x").alias("sx"), F.bit_xor("y").alias("sy"))
        slices = slices.select("conv_id", SLICE, F.coalesce(F.bit_xor("sx").over(earlier), zero).alias("sx"), F.coalesce(F.bit_xor("sy").over(earlier), zero).alias("sy"))
        own = own.join(slices, ["conv_id", SLICE])
        first = _xor(F.col("la"), F.col("sx")), _xor(F.col("lb"), F.col("sy"))
    else:
        first = F.col("la"), F.col("lb")
    so_far = Window.partitionBy("conv_id", SLICE).orderBy("d").rowsBetween(*_UP_TO_HERE)
    a, b = (_xor(f, F.bit_xor(v).over(so_far)) for f, v in zip(first, ("x", "y")))
    own = own.select(F.col("conv_id").alias("c"), "d", "x", "y", "words", a.alias("a"), b.alias("b"), (F.col("d") == F.col("total")).alias("last"))
    lead = lead.join(ids.select("c", "total"), "c").select("c", "d", "x", "y", "words", "a", "b", (F.col("d") == F.col("total")).alias("last"))
    both = own.union(lead).select("c", "d", "a", "b", _xor(F.col("a"), F.col("x")).alias("pa"), _xor(F.col("b"), F.col("y")).alias("pb"), "words", "last")
    return scratch.pin(both), ids.select("c", "total")


def roll_up(values: DataFrame, paths: DataFrame, sums: list[str], scratch: Scratch, band: int = BAND) -> DataFrame:
    """(a, b, sums) totalled over the subtree of every node.

    ``values``: one row per node with its digest a, b, depth d, one conversation c through it, and numbers.
    ``paths``: (c, d, a, b), the nodes on the way of conversations, the root at depth 0 among them.
    """
    deepest = values.agg(F.max("d")).first()[0]
    if deepest is None:
        return values.select("a", "b", *sums)
    levels = paths.select("c", F.col("d").alias("pd"), "a", "b", F.floor(F.col("d") / band).alias("band"))

    def to_ancestors(nodes: DataFrame, of: Column) -> DataFrame:
        below = nodes.select("c", F.col("d"), of.alias("band"), *sums)
        return below.join(levels, ["c", "band"]).where("pd <= d").select("a", "b", *sums)

    inside = to_ancestors(values, F.floor(F.col("d") / band)).groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in sums])
    if deepest < band:
        return inside
    inside = scratch.pin(inside)
    roots = values.where(F.col("d") % band == 0).select("a", "b", F.floor(F.col("d") / band).alias("d"), "c").join(inside, ["a", "b"])
    roots = scratch.pin(roots)
    upper = paths.where(F.col("d") % band == 0).select("c", F.floor(F.col("d") / band).alias("d"), "a", "b")
    done = roots.select("a", "b", "c", "d").join(roll_up(roots, upper, sums, scratch, band), ["a", "b"]).where("d > 0")
    lifted = to_ancestors(done.withColumn("d", F.col("d") * band), F.floor(F.col("d") / band) - 1)
    return inside.union(lifted).groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in sums])


def prefix_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, digest.

    ``digest`` (hexadecimal, 128 bits) names the node. The result is written; what it was made from is deleted.
    """
    prepare(conversations.sparkSession)
    scratch = Scratch()
    paths, ids = _paths(conversations, scratch)
    node = paths.groupBy("a", "b", "d").agg(
        F.min("c").alias("c"), F.count(F.lit(1)).alias("n"), F.min("words").alias("words"), F.min("pa").alias("pa"), F.min("pb").alias("pb")
    )
    zero = F.lit(0).cast("long")
    root = ids.agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n")).where("n > 0").select(
        zero.alias("a"), zero.alias("b"), zero.alias("d"), "c", "n", zero.alias("words"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb")
    )
    nodes = scratch.pin(node.union(root))
    children = nodes.where("d > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    valued = scratch.pin(nodes.join(children, ["a", "b"], "left").select(
        *nodes.columns, F.coalesce("n_children", zero).alias("n_children"), F.col("n_children").isNull().cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * F.col("words")).alias("saved_tokens"),
    ))
    ways = paths.select("c", "d", "a", "b").union(ids.select("c", zero, zero, zero))
    sums = ["n_leaves", "saved_tokens"]
    total = roll_up(valued.select("a", "b", "d", "c", *sums), ways, sums, scratch, band)
    ended = paths.where("last").select("a", "b", "c").union(ids.where("total = 0").select(zero.alias("a"), zero.alias("b"), "c"))
    ends = chained_sha256(ended.withColumn("name", F.col("c").cast("string")), ["a", "b"], ["c"], "name", b",")
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("c").alias("parent_conv_id"))
    plain = valued.select("a", "b", "d", "c", "pa", "pb", "n", "n_children")
    out = plain.join(parents, ["pa", "pb"], "left").join(total, ["a", "b"]).join(ends, ["a", "b"], "left")
    return scratch.last(out.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", F.lit(_EMPTY_SHA256)).alias("ends_sha256"),
        F.concat(F.lpad(F.hex("a"), 16, "0"), F.lpad(F.hex("b"), 16, "0")).alias("digest"),
    ))
