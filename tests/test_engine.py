"""Statements over small tables of our own, held against DuckDB over the same rows."""

from __future__ import annotations

import io
import time

import duckdb
import pytest

from tessera.session import Engine
from tessera.sources.delimited import rows
from tessera.sources.store import statistics

STOCK = ["1|10|5|1.5|2019-03-01", "1|11|7|2.0|2020-01-31", "2|10|9|0.25|2020-02-29", "2|12|1|4.0|2021-12-31", "3|13|4|8.5|2018-07-04", "3|10|5|1.5|2019-03-01", "4|11|2|3.0|2020-06-15"]
PRICE = ["10|2.5|bolt", "11|0.75|nut, hex", "12|11.0|saw", "14|3.25|glue; fast"]
PLACE = ["1|north", "2|south", "3|north", "5|east"]
DDL = """
CREATE TABLE STOCK (place int, item int, pieces int, weight decimal, counted date, PRIMARY KEY (place, item), INDEX (counted));
CREATE TABLE PRICE (item int, cost decimal, label varchar(20), PRIMARY KEY (item));
CREATE TABLE PLACE (place int, side char(5));
"""
CASES = [
    "SELECT place, pieces FROM STOCK WHERE pieces > 4",
    "SELECT * FROM PLACE",
    "SELECT COUNT(*) AS n FROM STOCK WHERE pieces > 1000",
    "SELECT MIN(pieces) AS lo, MAX(weight) AS hi, COUNT(*) AS n, AVG(pieces) AS mean FROM STOCK",
    "SELECT SUM(pieces) + 1 AS v FROM STOCK WHERE NOT (item = 10 OR weight > 3.5)",
    "SELECT side, SUM(pieces) AS v FROM STOCK, PLACE WHERE STOCK.place = PLACE.place GROUP BY side",
    "SELECT s.item, COUNT(*) AS n FROM STOCK s GROUP BY s.item",
    "SELECT SUM(pieces * cost) AS worth, AVG(cost) AS mean FROM STOCK JOIN PRICE ON STOCK.item = PRICE.item",
    "SELECT label, side, pieces FROM STOCK, PRICE, PLACE WHERE (STOCK.item = PRICE.item) AND (STOCK.place = PLACE.place)",
    "SELECT COUNT(*) AS n FROM PRICE, PLACE",
    "SELECT COUNT(*) AS n FROM STOCK, PRICE WHERE STOCK.item < PRICE.item AND weight >= 1.5",
    "SELECT a.place AS p, b.place AS q FROM STOCK a, STOCK b WHERE a.item = b.item AND a.place <> b.place AND a.pieces < b.pieces",
    "SELECT label FROM (SELECT label, cost * 2 AS twice FROM PRICE) x WHERE x.twice > 5",
    "SELECT big, COUNT(*) AS n FROM (SELECT CASE WHEN pieces >= 5 THEN 'yes' WHEN pieces >= 2 THEN 'few' ELSE 'no' END AS big FROM STOCK) x GROUP BY big",
    "SELECT place FROM STOCK UNION SELECT place FROM PLACE",
    "SELECT place FROM STOCK UNION ALL SELECT place FROM PLACE",
    "(SELECT item FROM STOCK) UNION (SELECT item FROM PRICE) UNION (SELECT place FROM PLACE)",
    "SELECT pieces, item FROM STOCK NATURAL JOIN PLACE WHERE side = 'north'",
    "SELECT place, item FROM STOCK WHERE counted >= DATE '2020-01-01' AND counted < DATE '2021-01-01'",
    "SELECT pieces / 2 AS half FROM STOCK",
    "SELECT side, label FROM (PLACE JOIN STOCK ON PLACE.place = STOCK.place) JOIN PRICE ON STOCK.item = PRICE.item",
]
ORDERED = [
    ("SELECT item, place FROM STOCK ORDER BY item DESC, place", "SELECT item, place FROM STOCK ORDER BY item DESC, place"),
    ("SELECT pieces FROM STOCK ORDER BY weight - pieces, place", "SELECT pieces FROM STOCK ORDER BY weight - pieces, place"),
    ("SELECT item, place FROM STOCK ORDER BY item, place LIMIT 2, 3", "SELECT item, place FROM STOCK ORDER BY item, place LIMIT 3 OFFSET 2"),
    ("SELECT side, COUNT(*) AS n FROM PLACE GROUP BY side ORDER BY n DESC, side", "SELECT side, COUNT(*) AS n FROM PLACE GROUP BY side ORDER BY n DESC, side"),
]


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    for name, lines in (("stock", STOCK), ("PRICE", PRICE), ("Place", PLACE)):
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")
    (folder / "WIDE.csv").write_text("2000000000|2000000000\n")
    return str(folder)


@pytest.fixture(scope="module")
def engine(spark, data):
    e = Engine(spark, data)
    e.script(DDL)
    return e


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("CREATE TABLE STOCK (place INT, item INT, pieces INT, weight DOUBLE, counted DATE); CREATE TABLE PRICE (item INT, cost DOUBLE, label VARCHAR); CREATE TABLE PLACE (place INT, side VARCHAR)")
    for name, lines in (("STOCK", STOCK), ("PRICE", PRICE), ("PLACE", PLACE)):
        for x in lines:
            con.execute(f"INSERT INTO {name} VALUES ({', '.join('?' * (x.count('|') + 1))})", x.split("|"))
    return con


@pytest.mark.parametrize("text", CASES)
def test_select(engine, duck, text):
    assert sorted(tuple(r) for r in engine.sql(text).collect()) == sorted(duck.execute(text).fetchall())


@pytest.mark.parametrize("text, same", ORDERED)
def test_order(engine, duck, text, same):
    assert [tuple(r) for r in engine.sql(text).collect()] == duck.execute(same).fetchall()


def test_definitions(engine):
    t = engine.catalog.tables["STOCK"]
    assert (t.primary_key, t.indexes, t.schema["pieces"].dataType.simpleString()) == (["place", "item"], [["counted"]], "int")
    with pytest.raises(ValueError):
        engine.sql("CREATE TABLE X (A blob)")
    with pytest.raises(ValueError):
        engine.sql("DROP TABLE STOCK")
    assert "Scan" in engine.explain("SELECT item FROM PRICE")


def test_changes_act_in_order(spark, data):
    e = Engine(spark, data)
    e.script("CREATE TABLE PLACE (place int, side char(5)); INSERT INTO PLACE(side, place) VALUES ('west', 100); INSERT INTO PLACE(place) VALUES (101);")
    assert e.sql("SELECT place, side FROM PLACE WHERE place >= 100 ORDER BY place").collect() == [(100, "west"), (101, None)]
    e.sql("DELETE FROM PLACE WHERE PLACE.side > 'v' OR place < 5")  # unknown is not true: the row with a null stays
    assert sorted(tuple(r) for r in e.sql("SELECT place, side FROM PLACE").collect()) == [(5, "east"), (101, None)]
    e.sql("INSERT INTO PLACE VALUES (100, 'w;(')")  # later inserts are not deleted
    e.sql("UPDATE PLACE SET place = place + 1, side = 'new' WHERE place = 100 OR place = 101")
    assert sorted(tuple(r) for r in e.sql("SELECT place, side FROM PLACE").collect()) == [(5, "east"), (101, "new"), (102, "new")]
    for bad in ("INSERT INTO PLACE(Z) VALUES (1)", "INSERT INTO PLACE VALUES (1)", "UPDATE PLACE SET z = 1", "INSERT INTO NONE VALUES (1)"):
        with pytest.raises(ValueError):
            e.sql(bad)
    e.sql("DELETE FROM PLACE")
    assert e.sql("SELECT COUNT(*), SUM(place) FROM PLACE").collect() == [(0, None)]


def test_conditions_and_new_values_have_64_bits(spark, data):
    e = Engine(spark, data)
    e.script("CREATE TABLE WIDE (A int, B int)")
    assert e.sql("SELECT A + B, A * B FROM WIDE").collect() == [(4_000_000_000, 4 * 10**18)]
    e.sql("DELETE FROM WIDE WHERE A + B < 5")
    e.sql("UPDATE WIDE SET A = A + B WHERE A + B > 5")
    e.sql("INSERT INTO WIDE VALUES (3000000000, 1)")
    e.sql("UPDATE WIDE SET B = A * 2 WHERE B = 1")
    assert sorted(tuple(r) for r in e.sql("SELECT A, B FROM WIDE").collect()) == [(3_000_000_000, 6_000_000_000), (4_000_000_000, 2_000_000_000)]


def test_many_statements_cost_in_proportion(spark, data):
    e = Engine(spark, data)
    e.script("CREATE TABLE PLACE (place int, side char(5))")
    took, want = [], {(1, "north"), (2, "south"), (3, "north"), (5, "east")}
    for part in range(4):
        began = time.perf_counter()
        for i in range(25 * part, 25 * (part + 1)):
            e.sql(f"INSERT INTO PLACE VALUES ({1000 + i}, 's{i}')")
            e.sql(f"DELETE FROM PLACE WHERE place = {1000 + i - 10}")
        took.append(time.perf_counter() - began)
    want |= {(1000 + i, f"s{i}") for i in range(90, 100)}
    assert {tuple(r) for r in e.sql("SELECT place, side FROM PLACE").collect()} == want
    assert took[3] < 3 * min(took[:2]) + 2, took


def test_text_with_separators(engine):
    assert engine.sql("SELECT cost FROM PRICE WHERE label = 'glue; fast'").collect() == [(3.25,)]
    assert list(rows(engine.sql("SELECT place, item, pieces, counted FROM STOCK WHERE counted < DATE('2019-01-01')"))) == ["3|13|4|2018-07-04"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_views_are_built_saved_and_used_by_selects(spark, data, duck, tmp_path):
    first = Engine(spark, data, str(tmp_path), in_memory=False)
    first.script(DDL)
    assert [(v.table, v.date, v.rows) for v in first.views.views] == [("STOCK", "counted", 7)]
    first.build_view("SELECT place, pieces, counted FROM STOCK WHERE pieces > 3 AND place <> 2", "counted")
    second = Engine(spark, "nowhere", str(tmp_path))
    assert sorted(second.load()) == ["PLACE", "PRICE", "STOCK"]
    assert second.views.views == first.views.views and second.views.views[1].bounds["pieces"] == ["4", "7"]
    for e in (first, second):
        year = "SELECT place, item FROM STOCK WHERE counted >= DATE '2020-01-01' AND counted < DATE '2021-01-01'"
        few = "SELECT SUM(pieces) AS v FROM STOCK WHERE pieces > 4 AND place <> 2"
        joined = "SELECT label, pieces FROM STOCK, PRICE WHERE STOCK.item = PRICE.item AND pieces > 4 AND place <> 2"
        for text, view in ((year, "view_STOCK_0"), (few, "view_STOCK_1"), (joined, "view_STOCK_0"), ("SELECT * FROM STOCK", "view_STOCK_0"), ("SELECT item FROM PRICE", None)):
            df = e.sql(text)
            assert ("view_" in plan(df)) == (view is not None) and (view is None or view in plan(df)), text
            assert sorted(tuple(r) for r in df.collect()) == sorted(duck.execute(text).fetchall())
        assert "PartitionFilters: [isnotnull(view_year" in plan(e.sql(year))
    second.sql("DELETE FROM STOCK WHERE pieces > 6")
    assert "view_" not in plan(second.sql(few)) and second.sql(few).collect() == [(10,)]
    assert second.catalog.tables["PRICE"].primary_key == ["item"] and second.catalog.tables["STOCK"].rows == 7
    assert statistics(second.catalog.table("PRICE"), "item") == {"rows": 4, "item": (10, 14)}


def test_two_engines_do_not_touch_each_other(spark, data):
    a, b = Engine(spark, data), Engine(spark, data, in_memory=False)
    for e in (a, b):
        e.sql("CREATE TABLE PLACE (place int, side char(5))")
    a.sql("DELETE FROM PLACE")
    assert [e.sql("SELECT COUNT(*) FROM PLACE").first()[0] for e in (a, b)] == [0, 4]
    assert [e.spark.conf.get("spark.sql.join.preferSortMergeJoin") for e in (a, b)] == ["false", "true"]


def test_repl(spark, data):
    out = io.StringIO()
    Engine(spark, data).repl(io.StringIO("CREATE TABLE PLACE (place int,\n side char(5));\nSELECT side, place FROM PLACE\n WHERE place > 2 ORDER BY place; nonsense;\nSELECT COUNT(*) FROM PLACE;\n"), out)
    assert out.getvalue().replace("$> ", "").split() == ["north|3", "east|5", "4"]


def test_bad_value_fails(spark, tmp_path):
    (tmp_path / "PLACE.csv").write_text("1x|north\n")
    e = Engine(spark, str(tmp_path))
    e.sql("CREATE TABLE PLACE (place int, side char(5))")
    with pytest.raises(Exception, match="(?i)malformed|parse|cast"):
        e.sql("SELECT * FROM PLACE").collect()
