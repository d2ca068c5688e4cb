import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that operators use themselves
    "node long, hub string, rank int, words string, spans string, digest string, _turn int, _letters boolean, label int"
)


def frame(spark, rows):
    """Documents from (doc_id, text, lang, source) with further columns of clashing names."""
    full = [(d, t, la, s, None if t is None else len(t), 1, "h", 2, "w", "s", "d", 3, True, 4) for d, t, la, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def sentence(rng, n, base="abcdefgh"):
    return " ".join("".join(rng.choice(base) for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus():
    """Small corpus: copies, near copies, empty, null, short and long texts, repeated rows, missing columns."""
    rng = random.Random(5)
    rows = []
    for i in range(60):
        base = "abcdefgh" if i % 2 else "mnopqrst"
        text = ". ".join(sentence(rng, rng.randint(4, 12), base).capitalize() for _ in range(rng.randint(2, 9))) + "."
        rows.append((i, text, "aa" if i % 2 else "mm", f"s{i % 3}"))
    rows += [(100 + k, rows[3][1], "aa", "s0") for k in range(25)]  # copies
    for k in range(12):  # near copies
        words = rows[5][1].split(" ")
        words[(k * 7) % len(words)] = f"edit{k}"
        rows.append((200 + k, " ".join(words), "aa", None))
    rows += [
        (300, None, None, None), (301, "", "aa", "s1"), (302, " \n\t ", None, "s1"), (303, "one", "aa", "s1"), (304, "One", None, "s2"),
        (305, "two words", "aa", None), (306, "12345 !!!", "aa", "s1"), (307, "é" * 50 + " ünï 😀 code", "mm", "s1"),
        (308, sentence(rng, 30_000), "aa", "s2"), (309, "x" * 120_000, None, "s2"), (None, "no name at all here", "aa", "s1"),
    ]
    return [*rows, rows[7], rows[7], (300, None, None, None)]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
