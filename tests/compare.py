"""Runs a query's SQL on DuckDB and compares rows regardless of order."""

import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def key(row):
    return tuple((v is not None, str(type(v)), v) for v in row)


def assert_same(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    want = sorted((tuple(r[k] for k in order) for r in cur.fetchall()), key=key)
    cols = sorted(df.columns)
    assert cols == sorted(names)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=key)
    assert len(got) == len(want)
    assert got == want
