"""Runs a query's SQL in DuckDB and compares whole results."""

from __future__ import annotations

import os
from collections import Counter


def _norm(row):
    return tuple(round(x, 6) if isinstance(x, float) else tuple(x) if isinstance(x, list) else x for x in row)


def rows_of(sf: str, sql: str) -> tuple[list[str], Counter]:
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(sf):
        p = f"{sf}/{t}"
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    got = c.sql(sql)
    return list(got.columns), Counter(_norm(r) for r in got.fetchall())


def assert_same(df, sf: str, sql: str) -> None:
    columns, want = rows_of(sf, sql)
    assert sorted(columns) == sorted(df.columns)
    got = Counter(_norm(r) for r in df.select(*columns).collect())
    assert got == want, (list((want - got).items())[:3], list((got - want).items())[:3])
