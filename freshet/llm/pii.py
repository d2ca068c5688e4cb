"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans (fixed patterns and checks) always stay. Looser patterns propose further candidates. Regex,
gazetteer, shape and context labelers vote on all of them; expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is; its soft labels train a logistic span classifier,
which decides about the further candidates.

Only counts of (kind, votes, shape) patterns reach the driver, and there are fewer than 40 000 patterns.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import column_of
from freshet.runtime import pin

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = ("pattern", "gazetteer", "shape", "edges", "context")

# The base patterns.
_EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # the guard changes no match, only the time on long digit runs
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser patterns of the further candidates.
_SPELT_EMAIL = re.compile(r"[A-Za-z0-9._-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,64} ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,10}")
_NATIONAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{2,4}\)|0[0-9]{1,4})[ /-][0-9]{2,4}(?:[ -][0-9]{2,4}){1,3}(?![0-9])")
_WIDE_IP = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")

# Gazetteers and context words.
_ENDINGS = frozenset("com org net edu gov info biz io de fr es uk eu us ca au ch at it nl example test".split())
_CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 55 61 81 86 91".split())
_ISSUERS = frozenset("3456")
_FOR = (
    re.compile(r"mail|contact|write|address|kontakt|correo", re.I), re.compile(r"\bip\b|host|server|addr|ping|login", re.I),
    re.compile(r"card|visa|master|credit|karte|tarjeta|carte", re.I), re.compile(r"call|tel|phone|fax|mobile|anruf|tél", re.I),
)
_AGAINST = re.compile(r"version|release|isbn|order|part no|serial|invoice|build|chapter", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _EMAIL_LOCAL:
            start -= 1
        m = _EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ascii_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, whether it is a base span) in code points; base spans first by kind and start."""
    base = [(EMAIL, *span, True) for span in _emails(text)]
    loose: list[tuple[int, int, int, bool]] = []
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                base.append((IP, *m.span(), True))
    cards = []
    for m in _CARD.finditer(text):
        digits = _ascii_digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            cards.append((CARD, *m.span(), True))
        elif 13 <= len(digits) <= 19:
            loose.append((CARD, *m.span(), False))
    base += cards
    if "+" in text:
        base += [(PHONE, *m.span(), True) for m in _PHONE.finditer(text) if 8 <= len(_ascii_digits(m[0])) <= 15]
    if "(at)" in text or "[at]" in text:
        loose += [(EMAIL, *m.span(), False) for m in _SPELT_EMAIL.finditer(text)]
    loose += [(PHONE, *m.span(), False) for m in _NATIONAL_PHONE.finditer(text)]
    if text.count(":") >= 7:
        loose += [(IP, *m.span(), False) for m in _WIDE_IP.finditer(text)]
    if loose:
        # A loose span overlaps some base span if one of those that start before its end ends after its start.
        spans = sorted((s, e) for _, s, e, _ in base)
        starts, ends = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))
        free = 0
        for kind, s, e, _ in sorted(loose, key=lambda c: (c[1], -c[2], c[0])):
            before = bisect_left(starts, e)
            if s >= free and not (before and ends[before - 1] > s):
                base.append((kind, s, e, False))
                free = e
    return base


def votes(text: str, kind: int, start: int, end: int, is_base: bool) -> tuple[int, ...]:
    """One vote of each labeler: 1 for, -1 against, 0 abstains."""
    span = text[start:end]
    digits = _ascii_digits(span)
    if kind == EMAIL:
        known = 1 if span.rpartition(".")[2].strip().lower() in _ENDINGS else -1
        shape = 1 if len(span) >= 8 else -1
    elif kind == IP:
        known = 0 if ":" in span else (-1 if digits.startswith(("127", "0")) else 1)
        shape = 1 if len(set(digits)) >= 3 else -1
    elif kind == CARD:
        known = 1 if digits[:1] in _ISSUERS else -1
        shape = 1 if len(set(digits)) >= 5 else -1
    else:
        known = (1 if any(digits.startswith(c) for c in _CALLING) else -1) if span[0] == "+" else 0
        shape = 1 if len(set(digits)) >= 4 else -1
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    edges = -1 if any(c.isalnum() for c in around) else 1
    before = text[max(0, start - 40) : start]
    context = -1 if _AGAINST.search(before) else 1 if _FOR[kind].search(before) else 0
    return (1 if is_base else -1, known, shape, edges, context)


def shape_code(text: str, start: int, end: int) -> int:
    """Length class and the classes of the neighbouring characters, as one number below 36."""
    def neighbour(c: str) -> int:
        return 0 if not c or c.isspace() else 1 if c.isalnum() else 2

    size = min(3, (end - start) // 8)
    return (size * 3 + neighbour(text[start - 1] if start else "")) * 3 + neighbour(text[end : end + 1])


def pattern_code(kind: int, cast: tuple[int, ...], shape: int) -> int:
    code = kind
    for v in cast:
        code = code * 3 + v + 1
    return code * 36 + shape


def unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, votes (0, 1, 2 for against, abstain, for) and shapes of pattern codes."""
    shape, rest = codes % 36, codes // 36
    cast = np.zeros((len(codes), len(LABELERS)), np.int64)
    for i in range(len(LABELERS) - 1, -1, -1):
        cast[:, i] = rest % 3
        rest = rest // 3
    return rest, cast, shape


@dataclass
class SpanModel:
    """``reliability[k, v, y]``: chance that labeler k votes v when the truth is y; ``weights`` of the classifier."""

    reliability: np.ndarray
    prior: np.ndarray
    weights: np.ndarray

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(features(codes) @ self.weights)))


def features(codes: np.ndarray) -> np.ndarray:
    """One-hot kind, votes and shape parts, with a constant."""
    kind, cast, shape = unpack(codes)
    parts = [np.eye(4)[kind], *(np.eye(3)[cast[:, i]] for i in range(cast.shape[1]))]
    parts += [np.eye(4)[shape // 9], np.eye(3)[shape // 3 % 3], np.eye(3)[shape % 3], np.ones((len(codes), 1))]
    return np.hstack(parts)


def expectation_maximisation(kind: np.ndarray, cast: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reliabilities, priors by kind and the chance that each pattern is personal data.

    Starts from the share of votes in favour; votes are independent given the truth; counts are smoothed
    by one pseudo-vote, so a kind that never occurs does no harm.
    """
    truth = np.clip((cast - 1).sum(axis=1) / (2 * cast.shape[1]) + 0.5, 0.05, 0.95)
    reliability, prior = np.zeros((cast.shape[1], 3, 2)), np.full(4, 0.5)
    for _ in range(rounds):
        weight = np.stack([n * (1 - truth), n * truth], axis=1)
        for k in range(cast.shape[1]):
            for v in range(3):
                reliability[k, v] = 1 + weight[cast[:, k] == v].sum(axis=0)
            reliability[k] /= reliability[k].sum(axis=0)
        prior = (np.bincount(kind, n * truth, 4) + 1) / (np.bincount(kind, n, 4) + 2)
        log = np.log(np.stack([1 - prior[kind], prior[kind]], axis=1))
        for k in range(cast.shape[1]):
            log += np.log(reliability[k, cast[:, k]])
        truth = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return reliability, prior, truth


def fit_patterns(counts: dict[int, int]) -> SpanModel:
    """Model from the counts of vote patterns (Newton steps on the soft labels, with a ridge of one)."""
    codes = np.array(sorted(counts), np.int64)
    n = np.array([counts[c] for c in codes.tolist()], float)
    kind, cast, _ = unpack(codes)
    reliability, prior, truth = expectation_maximisation(kind, cast, n)
    x = features(codes)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ w)))
        gradient = x.T @ (n * (truth - p)) - w
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w + np.clip(np.linalg.solve(hessian, gradient), -4, 4)
    return SpanModel(reliability, prior, w)


_FOUND = "doc_id long, kinds array<int>, starts array<int>, ends array<int>, base array<boolean>, codes array<int>"


def _found(text: str) -> list[tuple[int, int, int, bool, int]]:
    return [
        (k, s, e, b, pattern_code(k, votes(text, k, s, e, b), shape_code(text, s, e))) for k, s, e, b in candidates(text)
    ]


def find_candidates(docs: DataFrame) -> DataFrame:
    """One row per document with its candidates as parallel arrays; a null text has none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_found(t) if t else [] for t in column_of(batch, "text").to_pylist()]
            lists = [[[c[i] for c in row] for row in found] for i in range(5)]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [column_of(batch, "doc_id"), *(pa.array(v, pa.list_(t)) for v, t in zip(lists, kinds))],
                ["doc_id", "kinds", "starts", "ends", "base", "codes"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, _FOUND)


def fit(found: DataFrame) -> SpanModel:
    rows = found.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
    return fit_patterns({r.code: r.n for r in rows})


def _spans(rows: list[tuple], model: SpanModel, threshold: float) -> list[tuple[int, int, int, bool]]:
    """Base spans and the further ones that the classifier accepts, by kind and start."""
    extra = [r for r in rows if not r[3]]
    if extra:
        keep = model.probability(np.array([r[4] for r in extra])) >= threshold
        extra = [r for r, k in zip(extra, keep.tolist()) if k]
    return sorted((k, s, e, b) for k, s, e, b, _ in [*(r for r in rows if r[3]), *extra])


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Personal data of every whole text: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    A null or empty text has no spans and the digest of the empty string. Repeated rows each get a row.
    The texts are scanned once; what was found is written (a few numbers per candidate), counted by
    pattern for the model, and read again for the decision. Nothing is shuffled but the pattern counts.
    """
    found = pin(find_candidates(docs))
    model = fit(found)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def text_of(spans: list[tuple]) -> str:
            return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, *_ in spans)

        for batch in batches:
            lists = [column_of(batch, c).to_pylist() for c in ("kinds", "starts", "ends", "base", "codes")]
            all_spans = [_spans(list(zip(*row)), model, threshold) for row in zip(*lists)]
            base = [[s for s in spans if s[3]] for spans in all_spans]
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(batch, "doc_id"), *(pa.array([sum(s[0] == k for s in row) for row in base], pa.int64()) for k in range(4)),
                    pa.array([hashlib.sha256(text_of(row).encode()).hexdigest() for row in base]),
                    pa.array([text_of(row) for row in all_spans]),
                    pa.array([len(a) - len(b) for a, b in zip(all_spans, base)], pa.int64()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )

    return found.mapInArrow(
        decide,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long",
    )


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The same rows and columns with every found span of ``text`` replaced by its kind, as in ``<EMAIL>``.

    ``n_chars``, where present, becomes the new length in code points. Overlapping spans (a card inside a
    phone number) are replaced as one, named after the first. A null text stays null.
    """
    model = fit(find_candidates(docs))
    counted = "n_chars" in docs.columns

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, at, last = [], 0, 0
        for kind, s, e, _ in sorted(_spans(_found(text), model, threshold), key=lambda c: (c[1], -c[2])):
            if s >= last:
                out += [text[at:s], f"<{KINDS[kind].upper()}>"]
            at = last = max(last, e)
        return "".join([*out, text[at:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts = [clean(t) for t in column_of(batch, "text").to_pylist()]
            columns = list(batch.columns)
            columns[names.index("text")] = pa.array(texts, batch.schema.field("text").type)
            if counted:
                at = names.index("n_chars")
                lengths = [old if t is None else len(t) for t, old in zip(texts, columns[at].to_pylist())]
                columns[at] = pa.array(lengths, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(work, docs.schema)
