"""Rows of a query in Spark and of its SQL in DuckDB."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

from tools.compare import rows


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def both(con: duckdb.DuckDBPyConnection, spark, folder: str, query, sql: str) -> tuple[Counter, Counter]:
    got, want = query(spark, folder).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    return rows(got), rows(want)
