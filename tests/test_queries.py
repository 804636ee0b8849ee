"""Every registered query against its SQL, bit for bit."""

import pytest
from oracle import assert_same, plan_of

import __spark_entry__ as entry_point

QUERIES = entry_point.library_queries()
ORACLES = {n: sql for n, sql in entry_point.oracle_sql().items() if n in QUERIES}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_small(spark, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    assert_same(df, ORACLES[name], sf_small)
    # All of it stays in the JVM, and nothing is a cross join.
    plan = plan_of(df)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ObjectHashAggregate"):
        assert bad not in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_check(spark, sf_check, name):
    assert assert_same(QUERIES[name](spark, sf_check), ORACLES[name], sf_check) > 0
