"""Rows of a Spark query and of its SQL in DuckDB, as comparable multisets."""

import datetime
import os
from collections import Counter
from decimal import Decimal

import duckdb


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def connect(folder):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        if f.endswith(".parquet"):
            con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    return con


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    q = con.sql(sql)
    assert sorted(q.columns) == columns
    at = [q.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in q.fetchall())
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
