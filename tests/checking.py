"""Compare a Spark query with its checking SQL on the same Parquet files."""

from __future__ import annotations

import math
import time

import duckdb

from scholia.sources.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return "∅"
    if isinstance(value, float):
        if math.isnan(value):
            return "∅"
        return f"{value:.6g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), sorted(columns)


def compare(spark, fn, oracle: str, folder: str, con=None):
    """(equal, message, n_rows, spark_seconds, oracle_seconds)"""
    con = con or connect(folder)
    t0 = time.time()
    df = fn(spark, folder)
    got, got_cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    rel = con.execute(oracle)
    cols = [d[0] for d in rel.description]
    types = [str(d[1]) for d in rel.description]
    want, want_cols = rows_of(cols, rel.fetchall())
    t2 = time.time()
    took = (t1 - t0, t2 - t1)
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", len(got), *took
    odd = [(c, t) for c, t in zip(cols, types) if "HUGEINT" in t or "DECIMAL" in t]
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; {odd}", len(got), *took
    if got != want:
        mine, theirs = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return False, f"{len(mine)} differ, first {got_cols}: {mine[:2]} != {theirs[:2]}; {odd}"[:900], len(got), *took
    return (not odd), f"types {odd}" if odd else "", len(got), *took
