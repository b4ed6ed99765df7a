"""Every query with SQL gives the SQL's rows; the others run and have a stable schema."""

from __future__ import annotations

import pytest

from oracle import assert_same
from symbolloom.plans import problems, reference

QUERIES = {**reference.queries(), **problems.queries()}
SQL = {**reference.oracle_sql(), **problems.oracle_sql()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, tiny, name):
    assert_same(QUERIES[name](spark, tiny), tiny, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, tiny, name):
    df = QUERIES[name](spark, tiny)
    assert df.columns and df.collect() is not None


def test_entry_file(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert 0 < len(entry.entry(spark).collect()) <= 20
