"""Compare a Spark result with its SQL twin, values and all."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    relation = con.sql(sql)
    ours, theirs = sorted(df.columns), sorted(relation.columns)
    if ours != theirs:
        return f"columns {ours} vs {theirs}"
    left = rows_of(df.columns, [tuple(row) for row in df.collect()])
    right = rows_of(relation.columns, relation.fetchall())
    if left == right:
        return None
    return f"{sum(left.values())} vs {sum(right.values())} rows; {list((left - right))[:3]} vs {list((right - left))[:3]}"
