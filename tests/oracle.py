"""Runs a query and its DuckDB SQL over the same files and compares names, rows and values."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 9)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return [plain(x) for x in value] if isinstance(value, (list, tuple)) else value


def assert_same(df, con, sql: str) -> None:
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    at = [names.index(c) for c in columns]
    expected = sorted(([plain(r[i]) for i in at] for r in cursor.fetchall()), key=repr)
    found = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=repr)
    assert found == expected
