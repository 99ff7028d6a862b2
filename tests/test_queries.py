"""Every registered query against its SQL, over whole tables at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, database

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WITH_SQL = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    modelled = set(entry.LLM_QUERIES) - set(entry.LLM_ORACLES)
    assert set(entry.queries()) - set(entry.oracle_sql()) == modelled


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, con, name):
    _, difference = compare(spark, con, SF, name)
    assert difference is None or difference.startswith("equal"), difference


def test_entry(spark):
    assert entry.entry(spark).count() == 15
