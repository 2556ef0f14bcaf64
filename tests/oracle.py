"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(columns)
    return sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in rows), key=repr)


def assert_same(spark, query, sql: str) -> None:
    if not DATA.exists():
        pytest.skip("the driver's tables aren't here")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    df = query(spark, str(DATA))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert got == want
