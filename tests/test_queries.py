"""Each registered query against its SQL on the given tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

DIRECTORY = "/root/testdata/sf0.001"
# Queries of the optional text package have their own tests.
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in entry.REGISTRY}
QUERIES = dict(entry.REGISTRY)


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


# These give no rows on the smallest tables.
EMPTY_OK: set[str] = set()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    problem = compare(spark, con, DIRECTORY, QUERIES[name], SQL[name])
    assert problem == "" or (problem == "no rows" and name in EMPTY_OK)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
