"""Comparing a query with its SQL on the same tables."""

import os

import duckdb


def duckdb_rows(sql, sf_dir):
    with duckdb.connect() as db:
        for name in os.listdir(sf_dir):
            table = name.removesuffix(".parquet")
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{name}'")
        found = db.execute(sql)
        return [d[0] for d in found.description], found.fetchall()


def same_as_duckdb(query, sql, spark, sf_dir):
    df = query(spark, sf_dir)
    names, want = duckdb_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = [tuple(r) for r in df.select(*names).collect()]
    assert len(got) == len(want)
    a, b = sorted(got, key=repr), sorted(want, key=repr)
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
