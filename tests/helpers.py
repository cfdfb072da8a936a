"""Comparison of a query with its DuckDB equivalent, as rows in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata"


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(cell, v)) if hasattr(v, "__len__") and not isinstance(v, str) else (bool(v) if type(v).__name__ in ("bool", "bool_") else v)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in records), key=repr)


def same(spark, query, sql, sf="sf0.001"):
    df = query(spark, f"{DATA}/{sf}")
    got = rows(df.columns, df.collect())
    result = duck(sf).execute(sql)
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want
