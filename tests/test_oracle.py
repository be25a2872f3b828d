"""Every registered query against its SQL in DuckDB, on whole tables."""

import pytest
from oracle import compare, database

import __spark_entry__ as entry
from opsframe import suite

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = suite.QUERIES, suite.ORACLE


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, QUERIES[name], SQL[name], FOLDER) == ""


def test_entry(spark):
    assert entry.entry(spark).count() == 8
