"""Every named query beside its SQL statement, on whole tables."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SLOW = {"experiment_grid"}  # covered by test_runs

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def sql():
    return connect(SF)


def test_entry(spark):
    out = entry.entry(spark).toPandas()
    assert set(out.columns) == {"split", "n", "vp_mean"} and set(out.split) == {"train", "val", "test"}


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW])
def test_query(spark, sql, name):
    got = entry.queries()[name](spark, SF).toPandas()
    statement = entry.oracle_sql().get(name)
    if statement is None:
        assert len(got)
    else:
        assert differences(got, sql.execute(statement).fetchdf()) is None
