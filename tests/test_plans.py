"""Views and the shapes of physical plans."""

from __future__ import annotations

import itertools
from datetime import date

import pytest

from tessera import queries
from tessera.plans.views import Conjunct, Need, ViewCatalog, implies, needs
from tessera.streaming import append_to, appended

FOLDER = "/root/testdata/sf0.001"
_HOLDS = {"=": lambda x, v: x == v, "<>": lambda x, v: x != v, "<": lambda x, v: x < v, "<=": lambda x, v: x <= v, ">": lambda x, v: x > v, ">=": lambda x, v: x >= v}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_implication_is_sound_and_complete_for_bounds():
    values = range(-1, 3)
    points = [x / 2 for x in range(-6, 10)]
    for p, a, q, b in itertools.product(_HOLDS, values, _HOLDS, values):
        true = all(_HOLDS[q](x, b) for x in points if _HOLDS[p](x, a))
        assert implies(Conjunct("c", p, a), Conjunct("c", q, b)) == true, (p, a, q, b)
    assert not implies(Conjunct("a", "=", 1), Conjunct("b", "=", 1))
    assert implies(Conjunct("a", "<", other="b"), Conjunct("a", "<", other="b"))
    assert not implies(Conjunct("a", "<", 3), Conjunct("a", "<", "x"))


def test_views_are_chosen_by_what_a_plan_needs(spark, tmp_path):
    t = queries.Tables(spark, FOLDER)
    views = ViewCatalog(str(tmp_path))
    whole = views.build(t.lineitem, "lineitem", "l_shipdate")
    small = views.build(t.lineitem, "lineitem", "l_shipdate", (Conjunct("l_quantity", "<", 25.0),))
    assert whole.rows == t.lineitem.count() > small.rows
    assert ViewCatalog(str(tmp_path)).load(spark) == [whole, small]
    text = "SELECT l_orderkey, sum(l_quantity) AS q FROM {lineitem} WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND 10 > l_quantity AND l_tax + 0 < 1 GROUP BY l_orderkey"
    (need,) = needs(spark.sql(text, lineitem=t.lineitem))
    assert need.columns == {"l_orderkey", "l_quantity", "l_shipdate", "l_tax"}
    assert Conjunct("l_quantity", "<", 10.0) in need.conjuncts and len(need.conjuncts) == 3
    assert views.choose("lineitem", [need]) == small and views.choose("orders", [need]) is None
    wide = Need(need.path, need.columns, need.conjuncts[:2])
    assert views.choose("lineitem", [wide]) == views.choose("lineitem", [need, wide]) == whole
    assert views.choose("lineitem", [Need(need.path, frozenset({"no_such"}), need.conjuncts)]) is None
    got = views.answer(lambda chosen: spark.sql(text, **({"lineitem": t.lineitem} | chosen)), {"lineitem": t.lineitem})
    assert "PartitionFilters: [isnotnull(view_year" in plan(got) and small.path in plan(got)
    assert sorted(got.collect()) == sorted(spark.sql(text, lineitem=t.lineitem).collect())
    twice = "SELECT a.l_orderkey FROM {lineitem} a, {lineitem} b WHERE a.l_orderkey = b.l_orderkey AND a.l_quantity < 5 AND b.l_quantity < 30"
    assert whole.path in plan(views.answer(lambda chosen: spark.sql(twice, **({"lineitem": t.lineitem} | chosen)), {"lineitem": t.lineitem}))


def test_scans_are_pruned_and_filters_pushed(spark):
    text = plan(queries.queries()["tpch_q6"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull" in text and "LessThan(l_quantity,25.0)" in text
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate" in text
    assert "l_comment" not in text and "l_returnflag" not in text


def test_aggregates_combine_before_the_shuffle(spark):
    text = plan(queries.queries()["tpch_q1"](spark, FOLDER))
    assert "partial_sum" in text


@pytest.mark.parametrize("name, node", [("hash_join", "ShuffledHashJoin"), ("sort_merge_join", "SortMergeJoin"), ("top_k", "TakeOrderedAndProject"), ("cross_join", "CartesianProduct|BroadcastNestedLoopJoin"), ("block_nested_loop_join", "CartesianProduct"), ("index_lookup_join", "In(l_orderkey"), ("order_by_expr", "rangepartitioning"), ("cache_memory", "InMemoryTableScan"), ("cache_disk", "InMemoryTableScan")])
def test_strategies(spark, name, node):
    text = plan(queries.queries()[name](spark, FOLDER))
    assert any(n in text for n in node.split("|"))


def test_stream_of_files(spark, tmp_path):
    from pyspark.sql import types as T

    source = tmp_path / "in"
    source.mkdir()
    schema = T.StructType().add("a", T.IntegerType()).add("d", T.DateType())
    for i, text in enumerate(("1|2020-01-01\n", "2|2020-01-02\n")):
        (source / f"{i}.csv").write_text(text)
        append_to(appended(spark, str(source), schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, date(2020, 1, 1)), (2, date(2020, 1, 2))]
