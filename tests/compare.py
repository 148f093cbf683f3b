"""Run a registered query in Spark and its SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def database(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    return value


def difference(spark, folder: str, run, sql: str) -> str | None:
    """None where the results agree, else what differs."""
    df = run(spark, folder)
    con = database(folder)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    columns = sorted(names)
    mine = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [names.index(c) for c in columns]
    other = Counter(tuple(plain(r[i]) for i in at) for r in theirs)
    if mine == other:
        return None
    only, missing = mine - other, other - mine
    return (
        f"rows {sum(mine.values())} and {sum(other.values())}; {columns}; only Spark {sum(only.values())}: "
        f"{list(only)[:3]}; only SQL {sum(missing.values())}: {list(missing)[:3]}"
    )
