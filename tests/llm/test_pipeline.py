"""The pipeline stage by stage on a small corpus, and the registered queries on the given tables."""

import os
import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from freshet.llm import language
from tests.compare import connect, differences
from tests.llm.conftest import corpus, frame, sentence
from tests.llm.test_text_operators import plain_components, plain_pii

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark, tmp_path):
    rows = corpus()
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows += [(800, f"Some words before. {item} and after it.", "aa", "s"), (801, f"mail me at joe@mail.example please, {rows[2][1]}", "mm", "s")]
    words, rng = f"{item} some words before and after it mail me at joe please no name all here".split(), random.Random(3)
    rows += [(900 + k, " ".join(rng.choice(words).capitalize() if rng.random() < 0.1 else rng.choice(words) for _ in range(60)), "en", "s") for k in range(20)]
    spark.createDataFrame([(0, item), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, rows)
    columns = docs.columns
    kept = docs
    ids = lambda df: sorted((-1 if r.doc_id is None else r.doc_id) for r in df.select("doc_id").collect())
    steps = dict(corpus_pipeline.STAGES)

    kept = steps["language_id"](spark, kept, str(tmp_path))
    model = language.fit(docs)
    limits = language.rate_limits(docs, model)
    rates = {r.doc_id: r.bits_per_byte for r in language.identify(docs, model).collect()}
    names = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    fits = lambda d, t: (rates[d] - limits[names[d]]) * len(t.encode()) <= language.RATE_SLACK_BITS
    want = sorted(-1 if d is None else d for d, t, *_ in rows if any(c.isalpha() for c in t or "") and fits(d, t))
    assert kept.columns == columns and ids(kept) == want and len(want) > 90 and 309 not in want

    left = [(r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()]
    _, components = plain_components([(d, t, None, None) for d, t in left], 5, 80)
    kept = steps["near_dedup"](spark, kept, str(tmp_path))
    assert kept.columns == columns and ids(kept) == sorted([-1, *set(components.values())])

    kept = steps["decontamination"](spark, kept, str(tmp_path))
    assert kept.columns == columns and ids(kept) == sorted({-1, *components.values()} - {800})

    kept = steps["pii"](spark, kept, str(tmp_path))
    assert kept.columns == columns and 800 not in ids(kept)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[801].startswith("mail me at <EMAIL> please") and not any(plain_pii(t or "") for t in texts.values())

    packed = steps["packing"](spark, kept, str(tmp_path)).toPandas()
    assert set(packed.doc_id.fillna(-1)) == set(ids(kept)) and packed.groupby("sequence_id").length.sum().max() <= 4096


def test_decontamination_tells_rows_apart(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [(None, f"{item} and more"), (None, "nothing in here"), (None, None), (7, item), (7, "another text"), (8, None)]
    kept = corpus_pipeline.drop_contaminated(spark, frame(spark, [(d, t, "aa", "s") for d, t in texts]), str(tmp_path))
    left = {(r.doc_id, r.text) for r in kept.collect()}
    assert left == {(None, "nothing in here"), (None, None), (7, "another text"), (8, None)}


def test_documents_that_share_a_doc_id_stay_apart(spark, tmp_path):
    rng = random.Random(1)
    one, two, three, four = (sentence(rng, 60) for _ in range(4))
    rows = [(1, one), (1, two), (1, three), (1, two), (2, f"{two} more"), (3, one), (4, four), (4, four), (None, one), (None, None)]
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(spark, [(d, t, "aa", "s") for d, t in rows]), str(tmp_path))
    left = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in kept.collect())
    first = min(one, two, three)
    # The text that sorts first has the number 1 or the numbers above all ids do: groups keep their least real id.
    assert left == sorted([(-1, one), (-1, ""), (1, three), (2, f"{two} more"), (3, one), (4, four)]) and first


def test_noise_and_other_languages_are_not_kept(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, 40, "abcdefgh" if i % 2 else "mnopqrst"), "aa" if i % 2 else "mm", "s") for i in range(200)]
    noise = [" ".join("".join(rng.choice("uvwxyz") for _ in range(5)) for _ in range(40)), "Αυτό είναι ένα ελληνικό κείμενο " * 5, "x = y[0x7f] ** 2; " * 12]
    odd = [(1000 + k, t, "aa", "s") for k, t in enumerate(noise)]
    kept = corpus_pipeline.identify_language(spark, frame(spark, rows + [(d, t, None, s) for d, t, _, s in odd]), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(200))


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


TEXT_QUERIES = sorted(n for n in entry.queries() if n == "pipeline" or n.startswith("op"))


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in TEXT_QUERIES} == {"pipeline", *(f"op{k}" for k in range(1, 14))}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
@pytest.mark.parametrize("name", TEXT_QUERIES)
def test_query(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    statement = entry.oracle_sql().get(name)
    if statement is None:
        assert len(got)
    else:
        assert differences(got, connect(SF).execute(statement).fetchdf()) is None
