"""Every registered query against its oracle SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect
from tidemark.session import clear_scratch

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
#: queries whose result is empty on the smallest tables
EMPTY_ON_SO_LITTLE: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, con, name):
    problem = compare(spark, con, FOLDER, QUERIES[name], ORACLES.get(name))
    clear_scratch(spark)
    if problem == "no rows":
        assert name in EMPTY_ON_SO_LITTLE
    else:
        assert not problem


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
