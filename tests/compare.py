"""Run a query and its SQL on the same tables and compare, rows in any order."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, bytearray):
        return bytes(v)
    return v


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def oracle_rows(sql: str, folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{src}'")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    return cols, cur.fetchall()


def difference(df, sql: str, folder: str) -> str:
    """Empty if equal, else what differs."""
    cols, want = oracle_rows(sql, folder)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}"
    order = sorted(cols)
    got = sorted((tuple(_norm(r[c]) for c in order) for r in df.collect()), key=_key)
    want = sorted((tuple(_norm(r[cols.index(c)]) for c in order) for r in want), key=_key)
    if len(got) != len(want):
        return f"{len(got)} rows, SQL has {len(want)}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, in {order}: {bad[:3]}" if bad else ""
