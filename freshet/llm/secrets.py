"""Secret scan with corpus-wide ownership frequency, all in column expressions.

Candidates come from three patterns. A candidate's hash is counted over the distinct repositories and
owners that hold it: what several owners or many repositories hold is a copied example, what one owner holds
in few repositories and looks random is taken for a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.runtime import pin

KINDS = ("assign", "access", "hex", "live")

# The patterns. Runs are matched whole, so a least length inside the pattern drops the same
# matches as a check afterwards; only an assignment's value is checked afterwards.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
SHORTEST_VALUE = 6

#: A value held by at least so many owners, or in so many repositories of whatever owners, is a copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 10
#: A live-looking value has at least so many characters, and so many different ones.
LIVE_LENGTH, LIVE_DIFFERENT = 12, 6
_PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|xxxx|your[_-]"


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, found>> in code points.

    The gaps between matches and the matches themselves have the same order, so their running lengths
    are the positions. Texts without a match are not cut at all.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("found")))
    kind = "array<struct<start:int,end:int,found:string>>"

    def step(seen: Column, pair: Column) -> Column:
        start = seen["at"] + pair["gap"]
        end = start + F.length(pair["found"])
        row = F.struct(start.alias("start"), end.alias("end"), pair["found"].alias("found"))
        return F.struct(end.alias("at"), F.concat(seen["rows"], F.array(row)).alias("rows"))

    empty = F.array().cast(kind)
    walked = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("rows")), step, lambda seen: seen["rows"])
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def _labelled(spans: Column, number: int, value) -> Column:
    return F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), value(s["found"]).alias("value"),
    ))


def candidates(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, text key, owner, repository, and its base spans by start, then kind."""
    text = F.col("text")
    assign = F.filter(
        _labelled(spans_of(text, ASSIGN), 0, lambda m: F.regexp_extract(m, ASSIGN, 2)), lambda s: F.length(s["value"]) >= SHORTEST_VALUE
    )
    access = F.when(text.contains("AKIA"), spans_of(text, ACCESS)).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))
    all_spans = F.array_sort(F.concat(assign, _labelled(access, 1, lambda m: m), _labelled(spans_of(text, HEX), 2, lambda m: m)))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"),
        F.col(repository).cast("string").alias("repository"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.select("doc_id", F.xxhash64("text").alias("text_key"), "owner", "repository", all_spans.alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """For each candidate hash: copies, distinct repositories and distinct owners. A null owner counts as one.

    Distinct pairs are made first and counted in two steps, so a value that is everywhere is shrunk before
    each shuffle.
    """
    each = found.select(F.explode("spans").alias("s"), "owner", "repository").select(
        F.sha2(F.col("s.value"), 256).alias("hash"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository")
    )
    pairs = each.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("copies"))
    by_owner = pairs.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("copies").alias("copies"))
    return by_owner.groupBy("hash").agg(
        F.sum("copies").alias("copies"), F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners")
    )


def _joined(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied for every document.

    A null text is empty: no spans, and the digest of the empty string. ``live`` spans cover the values that
    are live-looking; a value that is both an assignment and a run of hex digits is one live span. Repeated
    rows each get a row. The texts are scanned once; candidates (few beside the texts) are written and joined.
    """
    found = pin(candidates(docs, owner, repository))
    value = F.col("s.value")
    spread = found.where(F.size("spans") > 0).select("doc_id", "text_key", F.explode("spans").alias("s"))
    judged = spread.withColumn("hash", F.sha2(value, 256)).join(ownership(found), "hash")
    looks_live = (F.length(value) >= LIVE_LENGTH) & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DIFFERENT) & ~value.rlike(_PLACEHOLDER)
    copied = (F.col("owners") >= COPIED_OWNERS) | (F.col("repositories") >= COPIED_REPOSITORIES)
    live = F.struct((F.col("s.end") - F.length(value)).alias("start"), F.lit(3).alias("kind"), F.col("s.end").alias("end"))
    extra = judged.groupBy("doc_id", "text_key").agg(
        F.collect_set(F.when(looks_live & (F.col("owners") == 1) & ~copied, live)).alias("live"),
        F.size(F.collect_set(F.when(copied, F.col("hash")))).cast("long").alias("n_copied"),
    )
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    one = found.select("doc_id", "text_key", base.alias("base"))
    both = one.alias("a").join(extra.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.text_key = b.text_key"), "left")
    added = F.coalesce("b.live", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    count = lambda k: F.size(F.filter("a.base", lambda s: s["kind"] == k)).cast("long")
    return both.select(
        F.col("a.doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("a.base")), 256).alias("base_sha256"), _joined(F.array_sort(F.concat("a.base", added))).alias("spans"),
        F.size(added).cast("long").alias("n_live"), F.coalesce("b.n_copied", F.lit(0)).cast("long").alias("n_copied"),
    )
