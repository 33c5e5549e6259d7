"""Spark results against DuckDB's: same columns, rows and values, in any order."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    there = [d[0] for d in cur.description]
    assert sorted(there) == names, (sorted(there), names)
    at = [there.index(c) for c in names]
    want = sorted((tuple(plain(r[k]) for k in at) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, (names, len(bad), bad[:3])
