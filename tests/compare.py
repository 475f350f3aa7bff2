"""Spark results against DuckDB's, as sets of rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return str(x) if x is not None and not isinstance(x, (int, str, bool)) else x


def differences(spark, sf, run, sql):
    """An empty string, or what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.sql(sql)
    df = run(spark, sf)
    if sorted(df.columns) != sorted(got.columns):
        return f"columns {sorted(df.columns)} {sorted(got.columns)}"
    names = sorted(df.columns)
    a = sorted((tuple(_norm(r[c]) for c in names) for r in df.collect()), key=repr)
    at = [got.columns.index(c) for c in names]
    b = sorted((tuple(_norm(r[i]) for i in at) for r in got.fetchall()), key=repr)
    if len(a) != len(b):
        return f"rows {len(a)} {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} rows differ: {wrong[:3]}" if wrong else ""
