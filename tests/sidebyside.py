"""Runs a query and its SQL over the same Parquet tables and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb

ROOT = os.environ.get("TESTDATA_DIR", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(os.path.join(sf_dir, "*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 5) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 5) + 0.0
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return str(v.replace(tzinfo=None))
    return str(v)


def same_rows(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(_plain(r[k]) for k in at) for r in cur.fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want
