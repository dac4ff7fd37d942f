"""Compares a query with its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(_plain, v)) if isinstance(v, list) else v


def same(df, con, sql):
    """Equal names and equal rows in any order."""
    got = con.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(got.columns)
    at = [got.columns.index(n) for n in names]
    ours = sorted((tuple(_plain(r[n]) for n in names) for r in df.collect()), key=str)
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in got.fetchall()), key=str)
    assert ours == theirs
