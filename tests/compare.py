"""Row-by-row comparison of a Spark query with its SQL in DuckDB on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat().removesuffix("T00:00:00")
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def assert_same(df, sql: str, sf_dir: str) -> int:
    """Asserts equal column names and rows; returns the number of rows."""
    names, rows = duck(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(names, rows)
    assert len(ours) == len(theirs)
    for mine, other in zip(ours, theirs):
        assert mine == other
    return len(ours)
