"""Compares a query with its SQL in DuckDB: columns by name, rows as a multiset."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in (DATA / sf).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if hasattr(x, "to_integral_value"):
        return int(x) if x == x.to_integral_value() else float(x)
    if isinstance(x, list):
        return tuple(map(plain, x))
    return x


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def differences(df, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """What differs, or nothing."""
    got = rows(df.columns, df.collect())
    want = con.sql(sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(df.columns)} and {sorted(want.columns)}"
    want = rows(want.columns, want.fetchall())
    if got == want:
        return ""
    a, b = set(got), set(want)
    return f"{len(got)} and {len(want)} rows; only here {sorted(a - b, key=repr)[:2]}; only in SQL {sorted(b - a, key=repr)[:2]}"
