"""Side-by-side comparison of a query with its SQL oracle."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in sorted(glob.glob(f"{root}/*.parquet")):
        name = os.path.basename(p).removesuffix(".parquet")
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW \"{name}\" AS SELECT * FROM read_parquet('{at}')")
    return con


def norm(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, (int, float)):
        x = float(x)
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, dict):
        return tuple((k, norm(v)) for k, v in x.items())
    if hasattr(x, "asDict"):
        return norm(x.asDict())
    if isinstance(x, (list, tuple)):
        return tuple(norm(v) for v in x)
    return x


def bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> tuple[int, list, list]:
    """Rows of the query, and examples that only one side has."""
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = bag(cols, cur.fetchall())
    assert sorted(cols) == sorted(df.columns), (sorted(cols), sorted(df.columns))
    got = bag(df.columns, df.collect())
    return sum(got.values()), list((got - want).items())[:5], list((want - got).items())[:5]
