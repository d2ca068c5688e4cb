"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text; nothing is known of how it works. Successive prefixes of a
conversation are rendered, and consecutive outputs are compared: what the longer one adds behind the
shorter one is the new turn's span. If the shorter output is not the beginning of the longer one, the
template rewrote its history, which is reported. Inside a span, two probe texts in place of the turn's own
show where its text begins and ends.

A turn is rendered behind its whole past, prefix by prefix, so a template may look back as far as it likes.
That takes a conversation in one task (the template itself asks for all its turns) and work that grows with the
square of its length. A template can say that it needs less: its ``reach`` is the number of earlier turns that
what a turn adds may depend on (0 where turns are simply joined, as here). Then a turn is rendered behind that
many, ``CONTEXT_TURNS`` at least, which adds the same text; work and memory per turn are bounded, and the
slices of a long conversation can be worked on apart. Either way turns behind ``CONTEXT_TURNS`` others are
also rendered behind few, and a template whose added text differs there is reported: with a ``reach`` as one
that breaks it, without one the turn is placed all the same.

Order of turns and nulls: see ``conversations``. A null conv_id is a conversation of its own. An empty
table gives no rows. Very long texts are held one context at a time. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshet.llm.common import prepare
from freshet.llm.conversations import CHAIN_BYTES, SLICES, chained_sha256, order_number, turn_key
from freshet.operators.ordering import SLICE, ordered_view
from freshet.runtime import pin

CONTEXT_TURNS = 16
_PROBES = ("a", "b")
_OPENED, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_MARKED = re.compile(r"\\(.)", re.S)


@dataclass(frozen=True)
class MarkedTemplate:
    """Turns between control strings; what looks like one inside a role or text gets a backslash, reversibly."""

    #: ``render`` joins what each turn gives alone.
    reach: ClassVar[int] = 0
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"

    def escape(self, text: str) -> str:
        return _OPENED.sub(r"<\\\1|", text) if "|" in text else text

    def unescape(self, text: str) -> str:
        return _ESCAPED.sub(r"<\1|", text) if "|" in text else text

    def render(self, turns: list[tuple[str, str]]) -> str:
        return "".join(f"{self.start}{self._role(r)}\n{self.escape(t)}{self.end}\n" for r, t in turns)

    def role_of(self, head: str) -> str:
        """The role in what stands before a turn's text."""
        return _MARKED.sub(lambda m: "\n" if m[1] == "n" else m[1], self.unescape(head[len(self.start) : -1]))

    def _role(self, role: str) -> str:
        return self.escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


@dataclass(frozen=True)
class Located:
    """One turn's added text: ``piece``, its own text at [begin, end), and how the template behaved.

    ``status``: ``added``; ``rewritten``: an earlier output changed; ``distant``: the addition depends on
    turns further back than ``near``; ``opaque``: the text cannot be told from its surroundings.
    """

    piece: str
    begin: int
    end: int
    status: str


def common_prefix(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:  # the greatest length at which both agree
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


def locate(
    render, history: list[tuple[str, str]], before: str, turn: tuple[str, str], far: bool, near: int = CONTEXT_TURNS // 2
) -> tuple[Located, str]:
    """Where a turn lies behind ``history``, whose output is ``before``; also the output with the turn.

    ``far`` asks whether the last ``near`` turns alone would have given the same.
    """
    after = render([*history, turn])
    same = len(before) if after.startswith(before) else common_prefix(before, after)
    piece, status = after[same:], "added" if same == len(before) else "rewritten"
    one, two = (render([*history, (turn[0], p)]) for p in _PROBES)
    head = max(common_prefix(one, two) - same, 0)
    tail = common_prefix(one[::-1], two[::-1])
    fits = one != two and head + tail <= len(piece) and one[same : same + head] == piece[:head]
    fits = fits and (tail == 0 or one[-tail:] == piece[-tail:])
    if status == "added" and not fits:
        status = "opaque"
    if status == "added" and far:
        last = history[-near:]
        if render([*last, turn]) != render(last) + piece:
            status = "distant"
    begin, end = (head, len(piece) - tail) if fits else (len(piece), len(piece))
    return Located(piece, begin, end, status), after


_SPANS = (
    "_no_id boolean, _conv long, _slice int, number long, role string, start long, text_start long, text_end long, "
    "loss boolean, status string, head string, body string"
)
_SPAN_TYPES = pa.schema([
    ("_no_id", pa.bool_()), ("_conv", pa.int64()), ("_slice", pa.int32()), ("number", pa.int64()), ("role", pa.string()), ("start", pa.int64()),
    ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_()), ("status", pa.string()), ("head", pa.string()), ("body", pa.string()),
    ("tail", pa.string()),
])
_DIGESTS = (
    "_no_id boolean, _conv long, _slice int, number long, n_turns long, loss_chars long, formatted_chars long, bad long, "
    "turns_sha256 string, loss_sha256 string, turns_bytes binary, loss_bytes binary"
)
_DIGEST_TYPES = pa.schema([
    ("_no_id", pa.bool_()), ("_conv", pa.int64()), ("_slice", pa.int32()), ("number", pa.int64()), ("n_turns", pa.int64()), ("loss_chars", pa.int64()),
    ("formatted_chars", pa.int64()), ("bad", pa.int64()), ("turns_sha256", pa.string()), ("loss_sha256", pa.string()),
    ("turns_bytes", pa.binary()), ("loss_bytes", pa.binary()),
])


def _filled(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Batches of at most 1000 rows or about a megabyte."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if len(held) >= 1000 or weight >= CHAIN_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class _Chats:
    """Conversations dealt to tasks in order, and the slices of those too large for one."""

    def __init__(self, conversations: DataFrame, template):
        #: Turns that what a turn adds may depend on; None: any number.
        self.reach = getattr(template, "reach", None)
        prepare(conversations.sparkSession)
        rows = conversations.select(
            F.col("conv_id").isNull().alias("_no_id"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("_conv"),
            order_number().alias("_turn"), turn_key().alias("_key"),
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        )
        #: Conversations in slices; bounded: at most so many groups are above the share.
        self.cut, df = set(), rows
        if self.reach is not None:
            view = ordered_view(rows, ["_no_id", "_conv"], ["_turn", "_key"], before=self.context, least_slices=SLICES)
            self.cut, df = {(r[0], r[1]) for r in view.plan.rows if r[-2]}, view.df
        if SLICE not in df.columns:
            df = df.select("*", F.lit(0).alias(SLICE), F.lit(False).alias("_copy"))
        keys = ["_no_id", "_conv", SLICE]
        self.turns = df.repartition(*keys).sortWithinPartitions(*keys, F.desc("_copy"), "_turn", "_key")

    @property
    def context(self) -> int | None:
        """Turns that a turn is rendered behind; None: all."""
        return None if self.reach is None else max(self.reach, CONTEXT_TURNS)

    @property
    def placed(self) -> tuple[str, ...]:
        """Statuses of turns whose place is sure."""
        return ("added", "distant") if self.reach is None else ("added",)


def _spans(chats: _Chats, template) -> DataFrame:
    """One row per turn, in the order of its task; ``start`` counts from the beginning of the slice."""
    context, placed, near = chats.context, chats.placed, max(chats.reach or 0, CONTEXT_TURNS // 2)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        group, history, before, whole, start, number = None, [], "", True, 0, 0
        for batch in batches:
            data = batch.to_pydict()
            for no_id, conv, part, copy, role, text in zip(*(data[c] for c in ("_no_id", "_conv", SLICE, "_copy", "role", "text"))):
                if group != (no_id, conv, part):
                    group, history, whole, start, number = (no_id, conv, part), [], part == 0, 0, 0
                    before = template.render([])
                turn = (role, text)
                if not copy:
                    if history and before is None:
                        before = template.render(history)
                    found, after = locate(template.render, history, before, turn, not whole or len(history) >= CONTEXT_TURNS, near)
                    head, body, tail = found.piece[: found.begin], found.piece[found.begin : found.end], found.piece[found.end :]
                    yield (
                        no_id, conv, part, number, role, start, start + found.begin, start + found.end,
                        role == "assistant" and found.status in placed, found.status, head, body, tail,
                    )
                    start, number = start + len(found.piece), number + 1
                history.append(turn)
                if copy or context is not None and len(history) > context:
                    history, before = history[-context:], None
                else:
                    before = after

    def run(batches):
        return _filled(walk(batches), _SPAN_TYPES, lambda r: len(r[-2]))

    return chats.turns.mapInArrow(run, f"{_SPANS}, tail string")


def render_conversations(conversations: DataFrame, template=MarkedTemplate()) -> DataFrame:
    """One row per turn: conv_id, number (from 0), role, formatted (the text that the turn adds), start (its place in
    the conversation's text), text_start and text_end (the turn's own text there), loss (whether it is learnt from),
    status.

    Joining ``formatted`` by ``number`` gives the conversation's text, unless some turn has the status
    ``rewritten``: then outputs do not grow by appending and spans of that conversation don't hold. ``template``: anything with
    ``render``; without a ``reach`` every turn is rendered behind all earlier ones.
    """
    chats = _Chats(conversations, template)
    spans = _spans(chats, template)
    if chats.cut:
        spans = pin(spans)
        size = F.length("head") + F.length("body") + F.length("tail")
        sizes = spans.groupBy("_no_id", "_conv", SLICE).agg(F.sum(size).alias("_size"), F.count(F.lit(1)).alias("_n"))
        earlier = Window.partitionBy("_no_id", "_conv").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        moved = sizes.select("_no_id", "_conv", SLICE, F.sum("_size").over(earlier).alias("_size"), F.sum("_n").over(earlier).alias("_n"))
        spans = spans.join(moved, ["_no_id", "_conv", SLICE], "left")
    else:
        spans = spans.select("*", F.lit(0).alias("_size"), F.lit(0).alias("_n"))
    by = F.coalesce("_size", F.lit(0))
    return spans.select(
        F.when(~F.col("_no_id"), F.col("_conv")).alias("conv_id"), (F.col("number") + F.coalesce("_n", F.lit(0))).alias("number"), "role",
        F.concat("head", "body", "tail").alias("formatted"), *[(F.col(c) + by).alias(c) for c in ("start", "text_start", "text_end")], "loss", "status",
    )


def format_digests(conversations: DataFrame, template=MarkedTemplate()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_unplaced, read back from the formatted text.

    Roles and texts are taken from the located spans and unescaped. ``n_unplaced`` counts turns whose
    place is not sure. A conversation lies in one task and needs no second shuffle, unless it holds a large share of
    all turns: then its slices hand on their bytes in pieces of a megabyte, hashed one after another.
    """
    chats = _Chats(conversations, template)
    cut, placed = chats.cut, chats.placed

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        group, state = None, None

        def row(number: int) -> tuple:
            n, loss_chars, chars, bad, turns, loss, turn_bytes, loss_bytes = state
            if group[:2] in cut:
                return (*group, number, n, loss_chars, chars, bad, None, None, b"".join(turn_bytes), b"".join(loss_bytes))
            return (*group, number, n, loss_chars, chars, bad, turns.hexdigest(), loss.hexdigest(), None, None)

        number, held = 0, 0
        for batch in batches:
            data = batch.to_pydict()
            for no_id, conv, part, status, loss, head, body, tail in zip(*(data[c] for c in ("_no_id", "_conv", SLICE, "status", "loss", "head", "body", "tail"))):
                now = (no_id, conv, part)
                if group != now or held >= CHAIN_BYTES:
                    if group is not None:
                        yield row(number)
                    number = number + 1 if group == now else 0
                    group, held, state = now, 0, [0, 0, 0, 0, hashlib.sha256(), hashlib.sha256(), [], []]
                text = template.unescape(body)
                said = f"{template.role_of(head)}\n{text}\n".encode()
                learnt = text.encode() if loss else b""
                state[0] += 1
                state[1] += len(text) if loss else 0
                state[2] += len(head) + len(body) + len(tail)
                state[3] += status not in placed
                if now[:2] in cut:
                    state[6].append(said)
                    state[7].append(learnt)
                    held += len(said)
                else:
                    state[4].update(said)
                    state[5].update(learnt)
        if group is not None:
            yield row(number)

    def run(batches):
        return _filled(digest(batches), _DIGEST_TYPES, lambda r: len(r[-2] or b"") + len(r[-1] or b""))

    found = _spans(chats, template).mapInArrow(run, _DIGESTS)
    counts = ("n_turns", "loss_chars", "formatted_chars", "bad")
    columns = ("_no_id", "_conv", *counts, "turns_sha256", "loss_sha256")
    if not cut:
        whole = found.select(*columns)
    else:
        found = pin(found)
        long = found.where(F.col("turns_sha256").isNull()).withColumn("_null", F.col("_no_id").cast("long"))
        keys, order = ["_null", "_conv"], [SLICE, "number"]
        sums = long.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
        for name in ("turns", "loss"):
            hashes = chained_sha256(long, keys, order, f"{name}_bytes").withColumnRenamed("sha256", f"{name}_sha256")
            sums = sums.join(hashes, keys)
        joined = sums.withColumn("_no_id", F.col("_null") == 1).select(*columns)
        whole = found.where(F.col("turns_sha256").isNotNull()).select(*columns).union(joined)
    return whole.select(
        F.when(~F.col("_no_id"), F.col("_conv")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars",
        F.col("bad").alias("n_unplaced"),
    )
