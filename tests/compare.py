"""Rows of a query and of its SQL, in a form that compares."""

import math
from datetime import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def compare(df, con, sql):
    """None if they agree; else what differs."""
    got = con.sql(sql)
    if sorted(got.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(got.columns)}"
    a, b = rows(df.columns, df.collect()), rows(got.columns, got.fetchall())
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y and not all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-5) for p, q in zip(x, y, strict=True))]
    return f"{len(bad)} rows differ, as {bad[0]}" if bad else None
