"""Compares a Spark query with its SQL in DuckDB, rows in any order."""

import glob
import os

import duckdb


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def same(spark, name, query, sql, folder):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = query(spark, folder)
    want = con.sql(sql)
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns, name
    got = sorted(repr(tuple(map(_plain, r))) for r in df.select(*columns).collect())
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(_plain(r[i]) for i in at)) for r in want.fetchall()), name
