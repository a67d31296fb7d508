"""Compares a query with its SQL in DuckDB, column by column in order of names, whatever the order of rows."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, query, sql: str, folder: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = query(spark, folder)
    names = sorted(df.columns)
    got = sorted(repr([r[n] for n in names]) for r in df.collect())
    found = con.execute(sql)
    columns = [x[0] for x in found.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    assert got == sorted(repr([r[i] for i in order]) for r in found.fetchall())
