"""Compares a query with its DuckDB SQL: columns by name, rows in any order, doubles to nine digits."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    c = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        at = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{at}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, sf_dir, query, sql, con=None) -> str:
    df = query(spark, sf_dir)
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = (con or connect(sf_dir)).execute(sql)
    b = rows_of([d[0] for d in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows; {[x for x in a[1] if x not in set(b[1])][:2]} {[x for x in b[1] if x not in set(a[1])][:2]}"
    bad = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    return f"{len(bad)} rows differ: {bad[:3]}" if bad else ("" if a[1] else "no rows")
