"""Comparing a Spark result with a DuckDB result, whatever the row order."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal
from pathlib import Path

import duckdb

SAMPLES = Path("/root/testdata")

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        path = Path(sf_dir, f"{table}.parquet")
        files = path / "*.parquet" if path.is_dir() else path
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{files}'")
    return db


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat() + "D"
    return value


def rows_of(columns, rows) -> list[tuple]:
    """Rows with columns in name order, sorted."""
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    plain = [tuple(_plain(r[i]) for i in at) for r in rows]
    return sorted(plain, key=lambda r: [(v is None, str(type(v)), v) for v in r])


def assert_same(spark_df, db, sql: str) -> int:
    """Assert equal column names, kinds of type and rows; return the row count."""
    result = db.sql(sql)
    assert sorted(spark_df.columns) == sorted(result.columns)
    kinds = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "timestamp_ntz": "TIMESTAMP", "date": "DATE",
    }
    expected = dict(zip(result.columns, map(str, result.types)))
    for name, kind in spark_df.dtypes:
        assert kinds[kind] == expected[name], f"{name}: {kind} against {expected[name]}"
    got = rows_of(spark_df.columns, spark_df.collect())
    want = rows_of(result.columns, result.fetchall())
    assert len(got) == len(want), f"{len(got)} rows against {len(want)}"
    for g, w in zip(got, want):
        assert g == w, f"{g} against {w}"
    return len(got)
