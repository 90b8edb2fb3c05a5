"""Comparison of a query with its SQL on the same files."""

import math
from collections import Counter
from datetime import datetime
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, Decimal)):
        return round(float(v), 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def same(df, con, sql):
    names = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(columns) == names
    theirs = Counter(tuple(plain(r[columns.index(c)]) for c in names) for r in got.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:2], list((theirs - mine).items())[:2])
