"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.oracle_check import mismatch

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_sql(spark, duck, sf, key):
    assert mismatch(QUERIES[key](spark, sf), duck, SQL[key]) is None


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, key):
    assert QUERIES[key](spark, sf).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 11
