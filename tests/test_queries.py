"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from suite.check import compare, connect
from suite.oracle import oracles
from suite.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"file_manifest", "storage_stats"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(oracles()) == set(QUERIES) - ROWS_ONLY


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "month" and df.count() > 0
    assert entry.queries().keys() == QUERIES.keys() | entry.LLM_QUERIES.keys()
    assert entry.oracle_sql() == oracles() | entry.LLM_SQL


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    verdict, _, count = compare(spark, con, SF, name)
    assert verdict in ("equal", "rows only")
    assert count > 0
