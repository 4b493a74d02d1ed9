"""Holds a query against its SQL in DuckDB."""

import os

import duckdb


def plain(v):
    if v is None:
        return "NULL"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def views(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return con


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(columns).collect())
    cursor = views(sf_dir).execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert got == want
