"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF_DIR, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, duck, name):
    problem = compare(spark, duck, SF_DIR, entry.queries()[name], SQL.get(name))
    if problem == "both empty":  # a comparison of nothing shows nothing
        problem = compare(spark, connect(LARGER), LARGER, entry.queries()[name], SQL.get(name))
    assert problem == "", problem


def test_entry_runs(spark):
    assert entry.entry(spark).columns[:2] == ["rank", "score"]


def test_every_sql_twin_has_a_query():
    assert set(SQL) <= set(entry.queries())
