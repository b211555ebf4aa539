"""Side-by-side runs of a registered query and its SQL."""

from __future__ import annotations

import datetime as dt
import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return f"{type(value).__name__}:{value}" if isinstance(value, (Decimal, bool)) else str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, fn, sql) -> str | None:
    """None when both sides agree, else a short account of the difference."""
    frame = fn(spark, sf_dir)
    got_cols, got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        sides = set(got), set(want)
        only_got = [r for r in got if r not in sides[1]][:3]
        only_want = [r for r in want if r not in sides[0]][:3]
        return f"rows {len(got)} vs {len(want)} cols={got_cols}\n   spark only {only_got}\n   sql only   {only_want}"
    return None if got else "no rows"
