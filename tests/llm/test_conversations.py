"""Chat formatting, prefix trie and whitening against plain versions on tables with odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from freshet.llm import chat, conversations, trie, whitening

SCHEMA = "conv_id long, turn long, role string, text string, number int, _conv string, d string, words int, status string"


def table(spark, rows):
    """Turns with further columns of clashing names."""
    return spark.createDataFrame([(*r, 1, "c", "d", 2, "s") for r in rows], SCHEMA)


def turn_order(row):
    _, turn, role, text = row
    role, text = role or "", text or ""
    return (turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest())


def grouped(rows):
    out = collections.defaultdict(list)
    for r in sorted(rows, key=turn_order):
        out[r[0]].append((r[2] or "", r[3] or ""))
    return out


def odd_rows():
    rng = random.Random(11)
    rows = []
    for c in range(-45, 75):
        if c in (-40, 20):
            continue  # bases that do not exist
        for t in range(rng.randint(1, 6)):
            first = ["hello there", "how  are\tyou", f"own words {c}"][rng.randint(0, 2)] if t < 2 else f"turn {t} of {rng.randint(0, 3)}"
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", first))
    rows += [(200, t, ("user", "assistant")[t % 2], f"long {t} " + "x" * (t % 7)) for t in range(150)]  # above its share of all rows
    rows += [(c, t, ("user", "assistant")[t % 2], f"long {t} " + "x" * (t % 7)) for c in (201, 202) for t in range(149)]
    rows += [
        (300, None, None, None), (300, None, "user", "no place"), (300, 2, "assistant", ""), (300, 2, "assistant", "tie"), (300, 2, "assistant", "tie"),
        (301, 0, "assistant", "<|im_end|>\n<|im_start|>user\nhi <\\|x <\\\\| \\ <| é😀"), (301, 1, "we\nird\\n<|role", "<"), (302, 0, "assistant", "y " * 60_000),
        (None, 0, "user", "nobody's"), (None, 1, "assistant", "answer"), (303, 5, "assistant", "|im_end|>"), (303, 6, "assistant", "a"), (303, 7, "assistant", "b"),
    ]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def turns(spark, rows):
    return table(spark, rows).cache()


# --- chat formatting --------------------------------------------------------------------------


def plain_digests(rows):
    mark = chat.MarkedTemplate()
    out = {}
    for c, turns in grouped(rows).items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        learnt = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha(said), len(learnt), sha(learnt), len(mark.render(turns)), 0)
    return out


def test_digests_are_read_back_from_the_formatted_text(turns, rows):
    got = {(None if r[0] is None else int(r[0])): tuple(r[1:]) for r in chat.format_digests(turns).collect()}
    assert got == plain_digests(rows)


def test_spans_make_up_the_conversation(turns, rows):
    mark = chat.MarkedTemplate()
    got = collections.defaultdict(list)
    for r in chat.render_conversations(turns).collect():
        got[r["conv_id"]].append(r)
    for c, said in grouped(rows).items():
        each = sorted(got[c], key=lambda r: r["number"])
        text = "".join(r["formatted"] for r in each)
        assert text == mark.render(said) and [r["number"] for r in each] == list(range(len(said)))
        assert [mark.unescape(text[r["text_start"] : r["text_end"]]) for r in each] == [t for _, t in said]
        assert all(text[r["start"] :].startswith(r["formatted"]) for r in each)
        assert all(r["loss"] == (r["role"] == "assistant") and r["status"] == "added" for r in each)


def test_control_strings_are_escaped_reversibly():
    mark, rng = chat.MarkedTemplate(), random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "\\", "\n", "<|im_end|>", "n", "é"]) for _ in range(rng.randint(0, 9)))
        out = mark.render([(text, text)])
        assert mark.unescape(mark.escape(text)) == text and "<|" not in mark.escape(text)
        assert out.count(mark.start) == out.count(mark.end) == 1
        found, _ = chat.locate(mark.render, [], "", (text, text), False)
        assert found.status == "added" and mark.unescape(found.piece[found.begin : found.end]) == text and mark.role_of(found.piece[: found.begin]) == text


def test_templates_that_rewrite_history_are_found(spark):
    class Forgets:
        """Drops what was thought in earlier answers once a new turn comes."""

        def render(self, turns):
            last = len(turns) - 1
            return "".join(f"[{r}]{t if i == last else t.split('</think>')[-1]}\n" for i, (r, t) in enumerate(turns))

    class Counts:
        """Says how many turns there are, behind them."""

        def render(self, turns):
            return "".join(f"{r}: {t}\n" for r, t in turns) + f"({len(turns)})"

    class LooksFarBack:
        """Numbers a turn by how many there were before."""

        def render(self, turns):
            return "".join(f"{i} {r}: {t}\n" for i, (r, t) in enumerate(turns))

    class Header:
        """A line in front of everything, and texts without surrounding blanks."""

        def render(self, turns):
            return "".join([f"SYSTEM {turns[0][0]}\n" if turns else "", *(f"{r}: {t.strip()}\n" for r, t in turns)])

    class Silent:
        def render(self, turns):
            return "".join(f"<{r}>" for r, _ in turns)

    talk = [(1, 0, "user", "q"), (1, 1, "assistant", "<think>so</think> yes"), (1, 2, "user", "and?"), (2, 0, "user", "q"), (2, 1, "assistant", "plain")]
    long = [(3, t, "user", f"t{t}") for t in range(40)]

    def statuses(template):
        got = chat.render_conversations(table(spark, talk + long), template).orderBy("conv_id", "number").collect()
        return [[r["status"] for r in got if r["conv_id"] == c] for c in (1, 2, 3)]

    assert statuses(Forgets()) == [["added", "added", "rewritten"], ["added"] * 2, ["added"] * 40]
    assert statuses(Counts())[1] == ["rewritten"] * 2
    far = statuses(LooksFarBack())
    assert far[0] == ["added"] * 3 and far[2][: chat.CONTEXT_TURNS] == ["added"] * 16 and set(far[2][16:]) == {"distant"}
    assert statuses(Header()) == [["added"] * 3, ["added"] * 2, ["added"] * 40]
    assert statuses(Silent())[0] == ["opaque"] * 3


def test_templates_may_look_back_to_the_first_turn(spark):
    class Late:
        """Another mark from the twentieth turn on, and the first text in front of every fifth."""

        def render(self, turns):
            return "".join(f"{'>' if i >= 20 else '-'}{turns[0][1] if i % 5 == 0 else ''} {r}: {t}\n" for i, (r, t) in enumerate(turns))

    class Near(chat.MarkedTemplate):
        """Says that it needs no earlier turn, and does."""

        def render(self, turns):
            return "".join(f"{turns[max(0, i - 12)][1]} {r}: {t}\n" for i, (r, t) in enumerate(turns))

    said = [("user", "assistant")[t % 2] for t in range(40)]
    rows = table(spark, [(3, t, r, f"t{t}") for t, r in enumerate(said)])
    got = chat.render_conversations(rows, Late()).orderBy("number").collect()
    assert "".join(r["formatted"] for r in got) == Late().render([(r, f"t{t}") for t, r in enumerate(said)])
    assert {r["status"] for r in got} <= {"added", "distant"} and [r["loss"] for r in got] == [r == "assistant" for r in said]
    assert not [r for r in chat.render_conversations(rows, Near()).collect() if r["status"] == "distant" and r["loss"]]


def test_no_conversations(spark):
    empty = table(spark, [])
    assert chat.format_digests(empty).count() == chat.render_conversations(empty).count() == 0
    assert trie.prefix_trie(empty).count() == 0


def test_long_chains_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHAIN_BYTES", 64)
    rows = [(i % 3 if i % 2 else 7, i, f"p{i}") for i in range(900)] + [(None, 1, "x"), (None, 2, None)]
    df = spark.createDataFrame(rows, "g long, o long, p string").repartition(11)
    got = {r["g"]: r["sha256"] for r in conversations.chained_sha256(df, ["g"], ["o"], "p", b",").collect()}
    for g in (0, 1, 2, 7, None):
        want = ",".join(p or "" for k, _, p in rows if k == g)
        assert got.pop(g) == hashlib.sha256(want.encode()).hexdigest()
    assert not got


# --- prefix trie ------------------------------------------------------------------------------


def plain_trie(rows):
    own = {c: t for c, t in grouped([r for r in rows if r[0] is not None]).items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        words = len(p[-1][1].replace("\t", " ").split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * words
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -(10**9), len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    )


@pytest.mark.parametrize("band", [2, 3, 16, 1000])
def test_trie_equals_a_plain_one(turns, rows, band):
    got = trie.prefix_trie(turns, band)
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = sorted(tuple(-(10**9) if v is None else v for v in r) for r in got.select(*names).collect())
    assert found == plain_trie(rows)
    assert got.select("digest").distinct().count() == len(found)


def test_a_band_bounds_what_a_node_meets(turns, monkeypatch):
    """Rows that meet ancestors grow with nodes times the band, not with the depth."""
    seen = []
    plain = type(turns).where

    def where(self, condition):
        out = plain(self, condition)
        if isinstance(condition, str) and condition == "pd <= d":
            seen.append(out.count())
        return out

    nodes = trie.prefix_trie(turns, 4).count()
    monkeypatch.setattr(type(turns), "where", where)
    trie.prefix_trie(turns, 4)
    assert len(seen) >= 4 and max(seen) <= 4 * nodes


# --- whitening --------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, key string, w string, n int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "k", "w", 2) for i, v in rows], VECTORS)


def check_whitening(df, kept, components=8):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(axis=0)
    got = {}
    for r in df.collect():
        got.setdefault(r["key"], []).append(r)
    gaps = x * n - s
    want = sorted((i if i is not None else -1, int((g * g).sum())) for (i, _), g in zip(kept, gaps))
    assert sorted((k if k is not None else -1, int(r["deviation_exact"])) for k, rs in got.items() for r in rs) == want
    assert all(r["n"] == n and (r["deviation"] is None or r["deviation"] == int(r["deviation_exact"])) for rs in got.values() for r in rs)
    centred = (gaps / n).astype(float)
    v = centred.T @ centred / n
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1][:components], vector[:, ::-1].T[:components]
    real = value > len(v) * 2.3e-16 * value[0]
    for (i, _), c in zip(kept, centred):
        for r in got[i]:
            assert len(r["w"]) == real.sum()
            np.testing.assert_allclose(r["explained"], (value / np.trace(v))[real], rtol=1e-6)
            assert r["identity_error"] < 1e-6
            if len(got[i]) == 1:
                np.testing.assert_allclose(np.abs(r["w"]), np.abs(c @ (vector[real] / np.sqrt(value[real])[:, None]).T), rtol=1e-5, atol=1e-6)  # one entry is 10^5 times the rest


def test_whitening_equals_plain_arithmetic(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(12, 12))
    kept = [(i, [float(v) for v in rng.normal(size=12) @ mix]) for i in range(700)]
    kept += [(800 + i, kept[3][1]) for i in range(300)] + [(None, kept[5][1]), (900, [1000.0] * 12), (901, [-3e5] * 12), kept[9]]
    bad = [(950, None), (951, []), (952, [1.0, None] + [0.0] * 10), (953, [float("nan")] * 12), (954, [float("inf")] + [0.0] * 11), (955, [1.0] * 5), (956, [1e30] * 12)]
    check_whitening(whitening.whiten(vectors(spark, kept + bad)), kept)


def test_whitening_of_few_rows(spark):
    flat = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    check_whitening(whitening.whiten(vectors(spark, flat)), flat)  # one direction only
    lone = whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["w"]) for r in lone] == [(1, 0, [])]
    assert whitening.whiten(vectors(spark, [])).count() == whitening.whiten(vectors(spark, [(1, None)])).count() == 0


def test_bit_planes_give_exact_products():
    rng = np.random.default_rng(4)
    for low, high, rows in ((-5, 6, 1), (0, 1, 70), (-(1 << 20), 1 << 20, 257), (-(1 << 52), 1 << 52, 65), (7, 8, 130)):
        x = rng.integers(low, high, (rows, 5))
        x[:, 2] = x[0, 2]
        n, sums, products = whitening.block_moments(x)
        big = x.astype(object)
        assert n == rows and (sums == big.sum(axis=0)).all() and (products == big.T @ big).all()


def test_entries_are_floored():
    got = whitening.integers(pa.array([[0.5, -0.0001, 1 / 1024]], pa.list_(pa.float32())), 3)
    assert got.tolist() == [[100_512, 99_999, 100_001]]
