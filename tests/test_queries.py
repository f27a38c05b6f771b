"""Every query with SQL must give the rows of that SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import ROOT, compare, connect

SF = f"{ROOT}/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, con, name):
    problem = compare(spark, con, SF, entry.queries()[name], ORACLES[name])
    # Some reports are rightly empty on the smallest tables.
    assert problem in (None, "no rows")


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
