"""Near duplicates by a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every text becomes a set of word shingles, a digest of the set, and a MinHash signature. Equal sets are
   one class and go on as one row.
2. Each class is posted under its (coordinate, value) pairs. Pairs that nobody else has are skipped, a
   class with fewer shared coordinates than a match needs is skipped whole, and of the others only the
   rarest K - t + 2 are posted: two signatures that agree in t of K coordinates share two of those.
3. Pairs of classes of one list are kept if their signatures agree in t coordinates or more, counted on eight
   bits a coordinate. First every member meets the least member of its list; the pairs kept join classes to
   parts. A list with one part only is settled. Otherwise the members outside the list's largest part meet all
   others. Where more than ``CROSS`` are outside, the list is posted anew under each two of a class's such lists;
   what is still above that hangs on its least member unseen. The kept pairs join classes to *candidate groups*.
4. Groups are cut into blocks of ``BLOCK`` classes, sorted by set size. Inside a block all sets are compared
   exactly. A block also meets the *centre* of its group, the class that shares the most coordinates.
5. Links join classes to components. What a centre leaves apart may still match members of other blocks:
   such a class counts how many of its shingles no other member has. That bounds the sizes it can match,
   and it is sent only to the blocks with such sizes, where it is compared exactly.

Steps 2 and 3 lose no pair that agrees in t coordinates, step 5 loses no link. The signature only proposes; every
link is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import byte_chunks, column_of, connected_components, constants, hash01, mix64, shingle_hashes, word_hashes
from freshet.runtime import keep, pin, temporary

COORDINATES = 32
#: Standard deviations by which the match threshold lies below the expected number of agreeing coordinates.
SLACK_SIGMAS = 5.0
#: Members outside the largest part of a posting list that meet all its members.
CROSS = 64
#: Classes of a candidate group that one task compares with each other.
BLOCK = 256
#: Blocks whose shingles meet in one part when shared ones are told from single ones.
PART_BLOCKS = 8
#: Shingles whose membership is laid out at once when sets are compared.
_COLUMNS = 16_384


def match_threshold(percent: int, coordinates: int = COORDINATES) -> int:
    p = percent / 100
    return max(1, int(coordinates * p - SLACK_SIGMAS * (coordinates * p * (1 - p)) ** 0.5))


def shingle_sets(texts: pa.Array, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text; empty for a text without words."""
    for first, data, offsets in byte_chunks(texts):
        hashes, word_offsets = word_hashes(data, offsets)
        shingles, bounds = shingle_hashes(hashes, word_offsets, words)
        for k in range(len(offsets) - 1):
            yield first + k, np.unique(shingles[bounds[k] : bounds[k + 1]])


def signatures(docs: DataFrame, words: int, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, digest (two numbers), signature and its low bytes of every document."""
    factors, width = constants(coordinates, 11), -(-coordinates // 8)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = constants(2, 12)
        for batch in batches:
            n = batch.num_rows
            sizes, low, high = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            rows = np.zeros((n, coordinates), np.int32)
            with np.errstate(over="ignore"):
                for k, own in shingle_sets(column_of(batch, "text"), words):
                    sizes[k] = len(own)
                    if len(own):
                        low[k] = mix64(own * marks[0]).sum(dtype=np.uint64)
                        high[k] = mix64(own ^ marks[1]).sum(dtype=np.uint64)
                        rows[k] = (mix64(own)[:, None] * factors >> np.uint64(33)).min(axis=0).astype(np.int32)
            flat = pa.array(rows.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * coordinates, coordinates), pa.int32()), flat)
            low_bytes = np.zeros((n, width * 8), np.uint8)
            low_bytes[:, :coordinates] = rows
            ends = pa.array(np.arange(0, (n + 1) * width, width), pa.int32())
            sketches = pa.ListArray.from_arrays(ends, pa.array(low_bytes.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), column_of(batch, "text_key"), pa.array(sizes), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), lists, sketches],
                ["doc_id", "text_key", "n_shingles", "low", "high", "signature", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        work, "doc_id long, text_key long, n_shingles long, low long, high long, signature array<int>, sketch array<long>"
    )


def agreeing(a: Column, b: Column, coordinates: int = COORDINATES) -> Column:
    """Coordinates in which two sketches have equal bytes."""
    total = F.lit(0)
    for i in range(-(-coordinates // 8)):
        x = F.get(a, i).bitwiseXOR(F.get(b, i))
        for shift in (4, 2, 1):  # the lowest bit of every byte tells whether any bit of it differs
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        total = total + F.lit(min(8, coordinates - 8 * i)) - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return total


def candidate_edges(classes: DataFrame, percent: int, coordinates: int = COORDINATES) -> DataFrame:
    """Edges (a, b) of reps between ``classes (rep, low, signature, sketch)``, told apart by ``low``, that agree in as many coordinates as a match needs.

    Every such pair is an edge or joined by a path of edges. Only lists that stay hot when two are combined
    give edges that were not counted.
    """
    least = match_threshold(percent, coordinates)
    posts = classes.select("low", F.posexplode("signature").alias("coordinate", "value"))
    posts = posts.select("low", F.xxhash64("coordinate", "value").alias("key"))
    lists = posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # A coordinate nobody shares is rarer than any other, so it takes a place of the prefix.
    own = posts.join(lists, "key").groupBy("low").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("lists"))
    kept = F.size("lists") - F.lit(max(least - 2, 0))
    prefixes = own.where(F.size("lists") >= least).select("low", F.slice("lists", F.lit(1), kept)["key"].alias("keys"))
    posted = pin(prefixes.join(classes.select("low", "rep", "sketch"), "low")).select("rep", "sketch", F.explode("keys").alias("key"))
    heads = posted.groupBy("key").agg(F.min(F.struct("rep", "sketch")).alias("head"))
    stars = posted.join(heads, "key").where(F.col("rep") != F.col("head.rep"))
    stars = stars.where(agreeing(F.col("sketch"), F.col("head.sketch"), coordinates) >= least)
    stars = pin(stars.select(F.col("rep").alias("a"), F.col("head.rep").alias("b")).distinct())
    parts = connected_components(stars).select(F.col("node").alias("rep"), F.col("component").alias("of"))
    posted = posted.join(parts, "rep", "left").select("rep", "sketch", F.coalesce("of", "rep").alias("part"), "key")
    pairs, hot = _across(pin(posted), least, coordinates)
    edges = stars.union(pairs)
    if hot is not None and least > 1:
        keys = hot.groupBy("rep", "sketch", "part").agg(F.sort_array(F.collect_set("key")).alias("keys"))
        twos = F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice("keys", i + 2, F.size("keys")), lambda y: F.xxhash64(x, y))))
        pairs, hot = _across(pin(keys.select("rep", "sketch", "part", F.explode(twos).alias("key"))), least, coordinates)
        edges = edges.union(pairs)
    if hot is not None:
        unseen = hot.join(hot.groupBy("key").agg(F.min("rep").alias("b")), "key").where("rep <> b")
        edges = edges.union(unseen.select(F.col("rep").alias("a"), "b"))
    return edges.distinct()


def _across(posted: DataFrame, least: int, coordinates: int) -> tuple[DataFrame, DataFrame | None]:
    """Counted pairs (a, b) between the parts of each list, and the posts of lists with too many members outside the
    largest part, if there are any. ``posted (rep, sketch, part, key)`` is a written table."""
    by_part = posted.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = by_part.groupBy("key").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("part", "n").alias("major"))
    mixed = pin(sizes.select("key", "major", (F.col("n") - F.col("most")).alias("outside")).where("outside > 0"))
    members = posted.join(mixed.where(F.col("outside") <= CROSS), "key")
    minor = members.where("part <> major").select("key", *(F.col(c).alias(f"my_{c}") for c in ("rep", "sketch", "part")))
    pairs = (
        minor.join(members, "key")
        .where("my_part <> part and (part = major or my_rep < rep)")
        .where(agreeing(F.col("my_sketch"), F.col("sketch"), coordinates) >= least)
        .select(F.col("my_rep").alias("a"), F.col("rep").alias("b")).distinct()
    )
    crowded = mixed.where(F.col("outside") > CROSS).select("key")
    return pin(pairs), None if crowded.isEmpty() else posted.join(crowded, "key")


def _links_within(sets: list[np.ndarray], percent: int, others: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Pairs of indexes of similar sets, of one list or of two.

    Common shingles of all pairs are counted by products of membership matrices.
    """
    both = sets + (others or [])
    if not both:
        return []
    sizes = np.array([len(s) for s in both])
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), sizes)
    _, number = np.unique(flat, return_inverse=True)
    count = np.bincount(number)
    shared = count[number] > 1
    columns, number = np.unique(number[shared], return_inverse=True)
    owner = owner[shared]
    split = len(sets) if others is not None else 0
    n_left, n_right = (sizes[:split], sizes[split:]) if others is not None else (sizes, sizes)
    common = np.zeros((len(n_left), len(n_right)), np.float32)
    for low in range(0, len(columns), _COLUMNS):  # a bounded part of the shingles at a time
        some = (number >= low) & (number < low + _COLUMNS)
        matrix = np.zeros((len(both), min(_COLUMNS, len(columns) - low)), np.float32)
        matrix[owner[some], number[some] - low] = 1
        common += matrix[:split] @ matrix[split:].T if others is not None else matrix @ matrix.T
    common = common.astype(np.int64)
    hit = 100 * common >= percent * (n_left[:, None] + n_right[None, :] - common)
    if others is None:
        hit &= np.tri(len(sets), k=-1, dtype=bool)
    i, j = np.nonzero(hit)
    return list(zip(i.tolist(), j.tolist()))


def _forest(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _texts_as_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
    for k, own in shingle_sets(texts, words):
        out[k] = own
    return out


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows with one value of ``key`` from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = column_of(batch, key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            if held and column_of(held[0], key)[0] != column_of(part, key)[0]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def near_duplicates(docs: DataFrame, words: int = 3, percent: int = 85, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document.

    Words are split at ASCII white space after lowering A-Z. Two documents are linked when their distinct
    shingle sets have 100 * intersection >= percent * union. A text with fewer words than a shingle is one
    shingle; one without words (or null) has none and is linked with nothing, so it is its own component.
    component_id is the smallest doc_id reachable, ``kept`` says whether it is the document's own. Rows that
    share a doc_id are one node and stay separate rows. A null doc_id is linked with nothing, its component
    is null and it is kept. An empty table gives an empty result. Only the table of the result stays behind.
    """
    with temporary(docs.sparkSession):
        return keep(_near_duplicates(docs, words, percent, coordinates))


def _near_duplicates(docs: DataFrame, words: int, percent: int, coordinates: int) -> DataFrame:
    signed = pin(signatures(docs, words, coordinates))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = pin(
        full.groupBy("low", "high", "n_shingles").agg(F.min(F.struct("doc_id", "text_key", "signature", "sketch")).alias("m"))
        .select("low", "high", "n_shingles", F.col("m.doc_id").alias("rep"), "m.text_key", "m.signature", "m.sketch")
    )
    # A doc_id with several texts may stand for several classes; they are linked by it in any case.
    edges = pin(candidate_edges(classes.select("rep", "low", "signature", "sketch"), percent, coordinates))
    groups = connected_components(edges).select(F.col("node").alias("rep"), F.col("component").alias("group"))
    links = confirmed_links(docs, classes, pin(groups), words, percent)
    members = full.join(classes.select("low", "high", "n_shingles", "rep"), ["low", "high", "n_shingles"])
    stars = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = connected_components(links.union(stars)).select(F.col("node").alias("doc_id"), "component")
    return (
        signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def confirmed_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between classes, enough to join all that are similar within a candidate group."""
    sized = pin(classes.join(groups, "rep").select("rep", "text_key", "group", "n_shingles", "signature"))
    # Blocks of a group follow the set size. Offsets by size, then by a hash inside a size, need no whole group in a task.
    by_size = sized.groupBy("group", "n_shingles").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("group").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_size.select("group", "n_shingles", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    at = F.floor((F.col("before") + hash01("rep") * F.col("n")) / BLOCK).cast("long")
    blocked = sized.join(offsets, ["group", "n_shingles"]).select("rep", "text_key", "group", "n_shingles", at.alias("block"))
    # The only time that all texts are shuffled: those of the candidate groups are written for what follows.
    keyed = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("text_key"), "text")
    texts = pin(keyed.join(blocked, ["rep", "text_key"]).dropDuplicates(["rep", "text_key"]).drop("text_key"))
    blocks = texts.groupBy("group", "block").agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    # Small tables that meet hot groups are written, so that Spark may split the other side of the join.
    blocks = pin(blocks)
    parts = F.ceil(F.col("n") / PART_BLOCKS).cast("int")
    many = pin(blocks.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group", parts.alias("parts")))
    # The centre of a group of several blocks goes to every block of it.
    centres = centre_of(sized.join(many.select("group"), "group")).join(many, "group")
    central = texts.select("rep", "text").join(centres, "rep").join(blocks.select("group", "block"), "group")
    everything = texts.select("rep", "text", "group", "block", F.lit(0).alias("parts")).union(
        central.select("rep", "text", "group", "block", "parts")
    )
    solved = pin(_solve(everything, words, percent))
    links = solved.where("b is not null").select("a", "b")
    return links.union(_second_look(texts, blocks, solved, words, percent))


def centre_of(sized: DataFrame) -> DataFrame:
    """The class of each group that agrees most with the values that are most frequent at each coordinate."""
    posts = sized.select("group", "rep", F.posexplode("signature").alias("coordinate", "value"))
    counts = posts.groupBy("group", "coordinate", "value").agg(F.count(F.lit(1)).alias("n"))
    modes = counts.groupBy("group", "coordinate").agg(F.max(F.struct("n", "value")).alias("m"))
    mode = pin(modes.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("coordinate", "m.value"))).alias("mode")))
    agree = F.aggregate(
        F.transform("signature", lambda v, i: (F.element_at("mode", i) == v).cast("int")), F.lit(0), lambda a, b: a + b
    )
    ranked = sized.join(mode, "group").groupBy("group").agg(F.max_by("rep", F.struct(agree, -F.col("rep"))).alias("rep"))
    return ranked.select("group", "rep")


_SOLVED = "group long, a long, b long, size long, part int, shingles array<long>, owners array<long>"


def _solve(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) inside blocks and to the centre. Where there is a centre (``parts`` above 0), also

    * the size of every loose class ``a``: one that the links do not join to the centre;
    * the shingles outside the centre, in ``parts`` hash parts of arrays. A shingle that only one loose class of
      the block has bears its owner, any other -1: repeats inside the block are combined here.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches, "key"):
            flags = table["parts"].to_pylist()
            reps, group = table["rep"].to_pylist(), table["group"][0].as_py()
            sets = _texts_as_sets(table["text"].combine_chunks(), words)
            order = [k for k, f in enumerate(flags) if f][:1] + [k for k, f in enumerate(flags) if not f]
            sets, reps = [sets[k] for k in order], [reps[k] for k in order]
            pairs = _links_within(sets, percent)
            roots = _forest(len(sets), pairs)
            out = [(group, reps[k], reps[r], None, None, None, None) for k, r in enumerate(roots) if reps[k] != reps[r]]
            parts = max(flags)
            if parts:
                loose = [k for k in range(1, len(sets)) if roots[k] != roots[0]]
                out += [(group, reps[k], None, len(sets[k]), None, None, None) for k in loose]
                extras = [np.setdiff1d(s, sets[0], assume_unique=True) for s in sets[1:]]
                flat, first, times = np.unique(np.concatenate(extras), return_index=True, return_counts=True)
                owner = np.repeat(np.arange(1, len(sets)), [len(e) for e in extras])[first]
                own = np.where((times == 1) & np.isin(owner, loose), np.array(reps)[owner], -1)
                part = (mix64(flat) % np.uint64(parts)).astype(np.int64)
                for p in np.unique(part).tolist():
                    out.append((group, None, None, None, p, flat[part == p].view(np.int64).tolist(), own[part == p].tolist()))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                names = ["group", "a", "b", "size", "part", "shingles", "owners"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    keyed = rows.withColumn("key", F.xxhash64("group", "block"))
    return keyed.repartition("key").sortWithinPartitions("key", F.desc("parts"), "rep").mapInArrow(work, _SOLVED)


def _owned(parts: DataFrame) -> DataFrame:
    """How many shingles each loose class has for itself in its group: (rep, u), in several rows per class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches, "key"):
            shingles = table["shingles"].combine_chunks().flatten().to_numpy()
            owners = table["owners"].combine_chunks().flatten().to_numpy()
            _, first, times = np.unique(shingles, return_index=True, return_counts=True)
            single = owners[first[times == 1]]
            reps, n = np.unique(single[single != -1], return_counts=True)
            if len(reps):
                yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(n.astype(np.int64))], ["rep", "u"])

    keyed = parts.select(F.xxhash64("group", "part").alias("key"), "shingles", "owners")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(work, "rep long, u long")


def _second_look(texts: DataFrame, blocks: DataFrame, solved: DataFrame, words: int, percent: int) -> DataFrame:
    """Links of loose classes to members of other blocks of their group.

    A shingle outside the centre that no other member has cannot be in an intersection. With u of those, a
    set of size n can match sets of a size m only if 100 (n - u) >= percent (m + u), and m >= percent n / 100.
    """
    unique = _owned(solved.where("part is not null")).groupBy("rep").agg(F.sum("u").alias("u"))
    loose = solved.where("size is not null").select(F.col("a").alias("rep"), "group", "size")
    alone = loose.join(unique, "rep", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    p = percent / 100
    most = (F.col("size") - F.col("u")) / p - F.col("u") + 1e-6
    ranges = alone.select("rep", "group", most.alias("highest"), (F.col("size") * p - 1e-6).alias("lowest")).where("highest >= lowest")
    own = texts.select("rep", F.col("block").alias("own"))
    visits = ranges.join(own, "rep").join(blocks, "group").where("least <= highest and most >= lowest and block <> own")
    visits = pin(visits.select("rep", "group", "block"))
    if visits.isEmpty():
        return visits.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    guests = texts.select("rep", "text").join(visits, "rep").select("rep", "text", "group", "block", F.lit(True).alias("guest"))
    hosts = texts.join(visits, ["group", "block"], "left_semi").select("rep", "text", "group", "block", F.lit(False).alias("guest"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches, "key"):
            guest = np.array(table["guest"].to_pylist())
            reps = np.array(table["rep"].to_pylist())
            sets = _texts_as_sets(table["text"].combine_chunks(), words)
            inside = np.flatnonzero(~guest)
            hosts_here = [sets[k] for k in inside]
            visitors = np.flatnonzero(guest)
            for low in range(0, len(visitors), BLOCK):
                part = visitors[low : low + BLOCK]
                pairs = _links_within([sets[k] for k in part], percent, hosts_here)
                links = [(int(reps[part[a]]), int(reps[inside[b]])) for a, b in pairs]
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    keyed = guests.union(hosts).withColumn("key", F.xxhash64("group", "block"))
    return keyed.repartition("key").sortWithinPartitions("key", "guest", "rep").mapInArrow(work, "a long, b long")
