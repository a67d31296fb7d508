"""Every registered relational query against DuckDB."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from oracle import compare
from pyspark.sql import functions as F

from tessera import queries
from tessera.operators import joins

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name], FOLDER)


@pytest.mark.parametrize("name", ["order_by_asc_desc", "order_by_unselected", "order_by_expr"])
def test_whole_tables_are_ordered(spark, name):
    """All rows of the table, in the order that DuckDB gives them."""
    table = "lineitem" if name == "order_by_expr" else "orders"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = [tuple(r) for r in queries.queries()[name](spark, FOLDER).collect()]
    assert got == con.execute(queries.oracle_sql()[name]).fetchall()
    assert len(got) == con.execute(f"SELECT count(*) FROM {table}").fetchone()[0]


def test_nested_derived_reads_all_customers(spark):
    rows = spark.read.parquet(f"{FOLDER}/customer.parquet").collect()
    want = sorted((a.c_name, b.c_name) for a in rows for b in rows if a.c_nationkey == b.c_nationkey and a.c_custkey != b.c_custkey and a.c_acctbal < b.c_acctbal and a.c_name > b.c_name)
    assert len(rows) > 100
    assert sorted(tuple(r) for r in queries.queries()["nested_derived"](spark, FOLDER).collect()) == want


@pytest.mark.parametrize("name", ["nested_derived", "self_theta_join", "equi_plus_theta"])
def test_pairs_of_a_hot_key_are_dealt_out(spark, name, tmp_path, monkeypatch):
    """All rows have one nation: no partition may have more than a few cells of the pairs, however many there are."""
    monkeypatch.setattr(joins, "BLOCK", 20, raising=False)
    con = duckdb.connect()
    for table, key, times in (("customer", "c_custkey", 2), ("supplier", "s_suppkey", 10)):
        con.execute(f"CREATE TABLE {table} AS SELECT * REPLACE ({key} + 1000 * i AS {key}, {key[0]}_name || i AS {key[0]}_name, CAST(3 AS INT) AS {key[0]}_nationkey) FROM '{FOLDER}/{table}.parquet', range({times}) r(i)")
        con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet'")
    got = queries.queries()[name](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert Counter(tuple(r)[:-1] for r in got) == Counter(con.execute(queries.oracle_sql()[name]).fetchall())
    sizes = Counter(r.task for r in got)
    assert len(got) > 20 * 20 * 5
    assert max(sizes.values()) <= 2 * 20 * 20


@pytest.mark.parametrize("kind", ["int", "double", "string"])
@pytest.mark.parametrize("block", [3, 10_000])
def test_grid_join_is_the_join(spark, monkeypatch, kind, block):
    """Equal rows, nulls, keys of one side alone, keys of two types, many blocks on one side and one on the other."""
    monkeypatch.setattr(joins, "BLOCK", block)
    left = spark.range(120).selectExpr(f"CAST(IF(id % 11 = 0, NULL, IF(id < 60, 1, id % 9)) AS {kind}) AS a", "id % 2 AS a2", "IF(id % 13 = 0, NULL, id % 5) AS x")
    right = spark.range(50).selectExpr(f"CAST(IF(id % 7 = 0, NULL, IF(id < 20, 1, id % 12)) AS {'bigint' if kind == 'int' else kind}) AS b", "id % 3 AS b2", "id % 4 AS y")
    if kind == "double":
        left, right = left.withColumn("a", F.expr("CASE a WHEN 2 THEN double('NaN') WHEN 3 THEN double('-0.0') ELSE a END")), right.withColumn("b", F.expr("CASE b WHEN 2 THEN double('NaN') WHEN 3 THEN 0 ELSE b END"))
    for keys in ([("a", "b")], [("a", "b"), ("a2", "b2")]):
        for residual in (F.lit(True), F.col("x") < F.col("y"), F.col("x") > 100):
            want = Counter(tuple(map(repr, r)) for r in joins.equi_join(left, right, keys, residual).collect())
            assert Counter(tuple(map(repr, r)) for r in joins.grid_join(left, right, keys, residual).collect()) == want
    assert joins.grid_join(left.limit(0), right, [("a", "b")], F.lit(True)).collect() == []
    with pytest.raises(ValueError, match="both sides"):
        joins.grid_join(left, left, [("a", "a")], F.lit(True))
