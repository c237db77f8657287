"""Runs a query beside its SQL in DuckDB and compares their rows, whatever their order."""

import os

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, con, query, sql, sf_dir=SMALL):
    df = query(spark, sf_dir)
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    order = sorted(df.columns)
    got = sorted(repr([r[c] for c in order]) for r in df.collect())
    at = [found.columns.index(c) for c in order]
    assert got == sorted(repr([r[i] for i in at]) for r in found.fetchall())
