"""Strict comparison of a registered query with its SQL twin run by DuckDB."""

from __future__ import annotations

import datetime
import decimal

import duckdb

from tidemark.catalog.registry import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        raise TypeError(f"decimal in result: {value}")
    if isinstance(value, float):
        return ("float", value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return "d" + value.isoformat()
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return _rows(df.columns, df.collect())


def sql_rows(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return _rows(names, cursor.fetchall())


def difference(df, con, sql) -> str | None:
    names, rows = spark_rows(df)
    other_names, other = sql_rows(con, sql)
    if names != other_names:
        return f"columns {names} vs {other_names}"
    if len(rows) != len(other):
        return f"rows {len(rows)} vs {len(other)}; first spark {rows[:1]} first sql {other[:1]}"
    bad = [(a, b) for a, b in zip(rows, other) if a != b]
    if bad:
        cells = [(n, x, y) for n, x, y in zip(names, *bad[0]) if x != y]
        return f"{len(bad)} of {len(rows)} rows differ, e.g. {cells}"
    return None
