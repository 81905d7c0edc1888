"""Run a query on Spark and its SQL twin on DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if hasattr(v, "as_tuple"):
        return ("decimal", float(v))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def kind(v) -> str:
    return "none" if v is None else type(v).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda x: tuple((v is None, str(type(v)), v if v is not None else 0) for v in x))


def compare(df, con, sql: str):
    """Returns None when equal, else a short text."""
    mine = df.collect()
    cur = con.execute(sql)
    theirs = cur.fetchall()
    names = [d[0] for d in cur.description]
    c1, r1 = rows_of(df.columns, mine)
    c2, r2 = rows_of(names, theirs)
    if c1 != c2:
        return f"columns {c1} != {c2}"
    if len(r1) != len(r2):
        return f"rows {len(r1)} != {len(r2)}"
    if not r1:
        return "no rows"
    for i, name in enumerate(c1):
        k1 = {kind(x[i]) for x in r1} - {"none"}
        k2 = {kind(x[i]) for x in r2} - {"none"}
        if k1 != k2:
            return f"type of {name}: {k1} != {k2}"
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    if bad:
        return f"{len(bad)} of {len(r1)} rows differ, columns {c1}, first {bad[0]}"
    return None
