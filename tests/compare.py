"""Run a query on Spark and its SQL on DuckDB and compare the rows, whatever their order."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, text: str) -> tuple[list[str], list[tuple]]:
    done = con.execute(text)
    columns = [c[0] for c in done.description]
    return sorted(columns), rows_of(columns, done.fetchall())


def difference(df, con, text: str) -> str | None:
    """None if both give the same rows, else what differs."""
    names, mine = spark_rows(df)
    other_names, theirs = duck_rows(con, text)
    if names != other_names:
        return f"columns {names} / {other_names}"
    if mine == theirs:
        return None
    left, right = set(mine) - set(theirs), set(theirs) - set(mine)
    return f"{len(mine)} / {len(theirs)} rows; only spark {list(left)[:2]}; only sql {list(right)[:2]}"
