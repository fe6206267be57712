"""Compare query results with their SQL statements: same rows, columns and values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def norm(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, int):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(norm(y) for y in x)
    return str(x)


def compare(df, con, sql: str) -> str:
    """Empty text when equal, else what differs."""
    names = sorted(df.columns)
    rel = con.execute(sql)
    have = [d[0] for d in rel.description]
    if sorted(have) != names:
        return f"columns {sorted(have)} against {names}"
    order = [have.index(n) for n in names]
    want = Counter(tuple(norm(r[i]) for i in order) for r in rel.fetchall())
    got = Counter(tuple(norm(v) for v in r) for r in df.select(*names).collect())
    if want == got:
        return ""
    return f"{sum(got.values())} rows against {sum(want.values())}; only Spark {list((got - want).items())[:2]}; only SQL {list((want - got).items())[:2]}"
