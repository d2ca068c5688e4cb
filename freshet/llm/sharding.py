"""Sharding by balanced label propagation.

Documents are linked through hubs (here: equal texts share one). In every round each hub takes the shard
where most of its documents are, hubs of overfull shards move on to shards with room, and documents move
towards the shard of their strongest hub as far as quotas allow. A last step makes the counts exact: what
a shard holds beyond its capacity and all unlinked documents fill the places that are left.

All that reaches the driver is a few numbers per shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import crc32_utf8, hash01, spread_rank
from freshet.runtime import pin

SHARDS = 24
ROUNDS = 6


def _lookup(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _loads(state: DataFrame, shards: int) -> list[int]:
    rows = {r.shard: r.n for r in state.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [rows.get(j, 0) for j in range(shards)]


def propagate(links: DataFrame, capacity: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Shards of linked nodes: ``links (node, hub)`` to (node, hub, shard, fellows), one row per node.

    The hub of a row is the node's strongest one, ``fellows`` the number of its nodes. Capacities hold about,
    not exactly: quotas are kept by hashed acceptance. A hub with more nodes than a shard may hold takes
    several shards. Hubs are counted by (hub, shard) before anything is joined, so a hub that links a third
    of all nodes is a few rows.
    """
    shards = len(capacity)
    # Written, so that the join reads both sides from plain exchanges and Spark can split a hot hub.
    sizes = pin(links.groupBy("hub").agg(F.count(F.lit(1)).alias("fellows")).where("fellows > 1"))
    links = pin(links.join(sizes, "hub"))
    strongest = F.max(F.struct("fellows", "hub")).alias("s")
    state = pin(
        links.groupBy("node").agg(strongest).select("node", "s.hub", "s.fellows", F.floor(hash01("node") * shards).cast("int").alias("shard"))
    )
    for step in range(rounds):
        load = _loads(state, shards)
        total = sum(load)
        if not total:
            break
        room = [max(0, c - n) for c, n in zip(capacity, load)]
        excess = _lookup([max(0, n - c) / max(1, n) for c, n in zip(capacity, load)])
        bounds, running = [], 0
        for r in room:
            running += r
            bounds.append(running)
        counts = links.join(state.select("node", "shard"), "node").groupBy("hub", "fellows", "shard").agg(F.count(F.lit(1)).alias("n"))
        ranked = F.sort_array(F.collect_list(F.struct("n", "shard")), asc=False)  # at most one entry per shard
        hubs = counts.groupBy("hub", "fellows").agg(F.transform(ranked, lambda x: x["shard"]).alias("best"))
        pick = hash01(F.lit(step), "hub")
        # A shard with room, in proportion to the room, for hubs that an overfull shard sends away.
        point = hash01(F.lit(-1 - step), "hub") * max(1, running)
        other = sum((F.when(point >= b, 1).otherwise(0) for b in bounds), F.lit(0))
        leaves = (pick < F.element_at(excess, F.col("best")[0] + 1)) & F.lit(running > 0)
        wide = F.ceil(F.col("fellows") / float(max(1, min(capacity)))).cast("int")
        hubs = hubs.select(
            "hub",
            F.when((wide == 1) & leaves, F.array(F.least(other, F.lit(shards - 1)).cast("int")))
            .otherwise(F.slice(F.concat("best", _missing(F.col("best"), shards)), F.lit(1), wide)).alias("targets"),
        )
        # Each node asks its strongest hub; of several targets it takes the one its own hash points at.
        wish = state.join(pin(hubs), "hub").withColumn(
            "target", F.element_at("targets", (F.floor(hash01("node") * F.size("targets")) + 1).cast("int"))
        )
        wish = pin(wish.select("node", "hub", "fellows", "shard", "target"))
        flows = wish.where("shard <> target").groupBy("shard", "target").agg(F.count(F.lit(1)).alias("n")).collect()
        into, out = [0] * shards, [0] * shards
        for f in flows:  # at most shards * shards rows
            into[f.target] += f.n
            out[f.shard] += f.n
        quota = _lookup([min(1.0, max(0, c - n + o) / i) if i else 1.0 for c, n, o, i in zip(capacity, load, out, into)])
        accepted = hash01(F.lit(1000 + step), "hub") < F.element_at(quota, F.col("target") + 1)
        state = pin(wish.select("node", "hub", "fellows", F.when(accepted, F.col("target")).otherwise(F.col("shard")).alias("shard")))
        if not flows:
            break
    return state


def _missing(present: Column, shards: int) -> Column:
    return F.array_except(F.sequence(F.lit(0), F.lit(shards - 1)), present)


def place(nodes: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Exact places of all nodes: ``nodes (node)`` and ``links (node, hub)`` to (node, shard, slot).

    Counts of shards differ by one at most, and slots count from 0 without a gap. ``node`` must be unique.
    """
    total = nodes.count()
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    state = propagate(links, capacity, rounds)
    # Hubs stay together in the order of places, unless a hub alone would make a large task.
    whole = F.when(F.col("fellows") <= max(1, total // (4 * shards)), hash01("hub")).otherwise(hash01("node"))
    ranked = pin(spread_rank(state.select("node", "shard", whole.alias("at")), ["shard"], ["at", "node"], position=F.col("at")))
    limit = F.element_at(F.array(*(F.lit(c) for c in capacity)), F.col("shard") + 1)
    kept = ranked.where(F.col("rank") < limit).select("node", "shard", F.col("rank").alias("slot"))
    held = _loads(kept, shards)
    free = pin(nodes.select("node").join(kept.select("node"), "node", "left_anti"))
    bounds, running = [], 0
    for c, n in zip(capacity, held):
        running += c - n
        bounds.append(running)
    filled = spread_rank(free, [], ["node"])
    shard = sum((F.when(F.col("rank") >= b, 1).otherwise(0) for b in bounds), F.lit(0)).cast("int")
    start = F.element_at(F.array(*(F.lit(n - b) for n, b in zip(held, [0, *bounds[:-1]]))), F.col("shard") + 1)
    filled = filled.withColumn("shard", shard).select("node", "shard", (start + F.col("rank")).alias("slot"))
    return kept.union(filled)


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Shard and slot of every document, equal texts linked: the contract columns with the law ``rows``.

    A null text has size 8 and the checksum of the empty text, and is linked with other texts without
    content. Repeated rows are documents of their own, linked by their text. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pin(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
            crc32_utf8(text).alias("text_crc32"), F.xxhash64(text).alias("hub"), F.monotonically_increasing_id().alias("node"),
        )
    )
    placed = place(rows, rows.select("node", "hub"), shards, rounds)
    return rows.join(placed, "node").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
