"""One query for each operator, on the tables of a folder, with the SQL that has the same result."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as op
from .functions import aggregate, scalar
from .functions.scalars import wide
from .operators.joins import self_join
from .plans.statements import spark_select
from .session import Engine
from .sources.delimited import lines, write_delimited

Query = Callable[["Tables"], DataFrame]
QUERIES: dict[str, tuple[Query, str]] = {}


class Tables:
    """The Parquet tables of a folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str, *names: str) -> DataFrame:
        """A SELECT over some of the tables, each in braces."""
        return self.spark.sql(spark_select(text), **{n: getattr(self, n) for n in names})


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda f: lambda spark, folder: f(Tables(spark, folder)))(f) for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}


c = F.col


# ---- scans, projection, filters


@query("SELECT * FROM nation")
def scan_all(t):
    return t.nation


@query("SELECT n_name, n_regionkey FROM nation")
def project_cols(t):
    return op.project(t.nation, "n_name", "n_regionkey")


@query("SELECT p_partkey, CAST(p_size AS BIGINT) * 3 - 2 AS scaled, round(p_retailprice * (1 + 0.1), 2) AS gross FROM part")
def project_expr(t):
    return op.project(t.part, "p_partkey", scaled=wide("p_size") * 3 - 2, gross=F.round(c("p_retailprice") * (1 + F.lit(0.1)), 2))


@query("SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'ASIA'")
def project_table_star(t):
    joined = t.nation.alias("n").join(t.region.alias("r"), c("n.n_regionkey") == c("r.r_regionkey"))
    return op.table_star(op.select(joined, c("r.r_name") != "ASIA"), "n")


def _compare(name: str, sign: str, condition: Callable[[], F.Column]) -> None:
    def f(t):
        return op.project(op.select(t.orders, condition()), "o_orderkey", "o_custkey")

    f.__name__ = name
    query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey {sign} 700")(f)


_compare("filter_eq", "=", lambda: c("o_custkey") == 700)
_compare("filter_ne", "<>", lambda: c("o_custkey") != 700)
_compare("filter_lt", "<", lambda: c("o_custkey") < 700)
_compare("filter_le", "<=", lambda: c("o_custkey") <= 700)
_compare("filter_gt", ">", lambda: c("o_custkey") > 700)
_compare("filter_ge", ">=", lambda: c("o_custkey") >= 700)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'R' AND l_discount > 0.05")
def filter_and(t):
    return op.select(t.lineitem, c("l_quantity") < 10, c("l_returnflag") == "R", c("l_discount") > 0.05).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' OR (o_orderstatus = 'F' AND o_totalprice > 100000)")
def filter_or(t):
    return op.select(t.orders, (c("o_orderpriority") == "1-URGENT") | ((c("o_orderstatus") == "F") & (c("o_totalprice") > 100000))).select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 0)")
def filter_not(t):
    return op.select(t.customer, ~((c("c_mktsegment") == "BUILDING") | (c("c_acctbal") < 0))).select("c_custkey", "c_mktsegment")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= DATE '1996-03-01' AND l_shipdate < DATE '1996-06-01'")
def filter_date(t):
    return op.select(t.lineitem, c("l_shipdate") >= scalar("DATE", "1996-03-01"), c("l_shipdate") < scalar("DATE", "1996-06-01")).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_partkey - l_suppkey > 5")
def filter_arith(t):
    return op.select(t.lineitem, wide("l_partkey") - wide("l_suppkey") > 5).select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 'high' WHEN o_totalprice > 150000 THEN 'dear' ELSE 'low' END AS kind FROM orders")
def case_when(t):
    kind = F.when(c("o_orderpriority").isin("1-URGENT", "2-HIGH"), "high").when(c("o_totalprice") > 150000, "dear").otherwise("low")
    return op.project(t.orders, "o_orderkey", kind=kind)


# ---- joins


@query("SELECT r_name, n_name FROM region, nation")
def cross_join(t):
    return op.cross_join(t.region, t.nation).select("r_name", "n_name")


@query("SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation")
def join_no_on(t):
    return t.sql("SELECT r_regionkey, n_nationkey FROM {region} JOIN {nation}", "region", "nation")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def equi_join_on(t):
    return op.equi_join(t.orders, t.customer, [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name")


_WHERE = "SELECT s_name, n_name FROM {supplier}, {nation} WHERE s_nationkey = n_nationkey"


@query(_WHERE.replace("{", "").replace("}", ""))
def equi_join_where(t):
    return t.sql(_WHERE, "supplier", "nation")


@query("SELECT l_orderkey, l_linenumber, c_custkey, s_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey")
def join_multi_key(t):
    orders = op.equi_join(op.equi_join(t.lineitem, t.orders, [("l_orderkey", "o_orderkey")]), t.customer, [("o_custkey", "c_custkey")])
    return op.equi_join(orders, t.supplier, [("l_suppkey", "s_suppkey"), ("c_nationkey", "s_nationkey")]).select("l_orderkey", "l_linenumber", "c_custkey", "s_suppkey")


@query("SELECT c_custkey, n_name, r_name FROM customer, nation, region WHERE (c_nationkey = n_nationkey) AND (n_regionkey = r_regionkey)")
def three_way_join(t):
    return op.equi_join(op.equi_join(t.customer, t.nation, [("c_nationkey", "n_nationkey")]), t.region, [("n_regionkey", "r_regionkey")]).select("c_custkey", "n_name", "r_name")


_SIX = """
SELECT r_name, n_name, c_custkey, o_orderkey, l_linenumber, s_name FROM {region}, {nation}, {customer}, {orders}, {lineitem}, {supplier}
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = n_nationkey AND s_nationkey = n_nationkey
AND n_regionkey = r_regionkey AND o_totalprice > 50000
"""


@query(_SIX.replace("{", "").replace("}", ""))
def six_way_join(t):
    return t.sql(_SIX, "region", "nation", "customer", "orders", "lineitem", "supplier")


@query("SELECT a.n_name AS a_name, b.r_name AS b_name FROM nation a, region b WHERE a.n_regionkey < b.r_regionkey")
def theta_join(t):
    return op.theta_join(t.nation, t.region, c("n_regionkey") < c("r_regionkey")).select(c("n_name").alias("a_name"), c("r_name").alias("b_name"))


@query("SELECT a.s_name AS a_name, b.s_name AS b_name FROM supplier a, supplier b WHERE a.s_suppkey <> b.s_suppkey AND a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def self_theta_join(t):
    joined = self_join(t.supplier, "a", "b", ["s_nationkey"], "a_s_suppkey <> b_s_suppkey AND a_s_acctbal < b_s_acctbal")
    return joined.select(c("a_s_name").alias("a_name"), c("b_s_name").alias("b_name"))


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE s_acctbal > c_acctbal OR c_mktsegment = 'BUILDING'")
def equi_plus_theta(t):
    supplier, customer = t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal"), t.customer.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return op.grid_join(supplier, customer, [("s_nationkey", "c_nationkey")], (c("s_acctbal") > c("c_acctbal")) | (c("c_mktsegment") == "BUILDING")).select("s_suppkey", "c_custkey")


@query("SELECT n_nationkey AS nationkey, n_name, s_name FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def natural_join(t):
    left = op.project(t.nation, "n_name", nationkey=c("n_nationkey"))
    return op.natural_join(left, op.project(t.supplier, "s_name", nationkey=c("s_nationkey")))


_BY_ORDER = "SELECT l_orderkey, l_linenumber, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'"


def _strategy(name: str, join: Callable[[DataFrame, DataFrame, list], DataFrame]) -> None:
    def f(t):
        return join(op.select(t.orders, c("o_orderstatus") == "O"), t.lineitem, [("o_orderkey", "l_orderkey")]).select("l_orderkey", "l_linenumber", "o_custkey")

    f.__name__ = name
    query(_BY_ORDER)(f)


_strategy("hash_join", op.hash_join)
_strategy("sort_merge_join", op.sort_merge_join)


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = 77")
def index_lookup_join(t):
    return op.index_lookup_join(op.select(t.orders, c("o_custkey") == 77), t.lineitem, [("o_orderkey", "l_orderkey")]).select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a, nation b WHERE a.n_nationkey + b.n_nationkey > 30")
def block_nested_loop_join(t):
    a, b = t.nation.select(c("n_name").alias("a_name"), c("n_nationkey").alias("a_key")), t.nation.select(c("n_name").alias("b_name"), c("n_nationkey").alias("b_key"))
    return op.block_nested_loop_join(a, b, wide("a_key") + wide("b_key") > 30).select("a_name", "b_name")


# ---- aggregates


def _total(name: str, sql: str, f: Callable[["Tables"], DataFrame]) -> None:
    f.__name__ = name
    query(sql)(f)


_total("agg_sum", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS v, round(sum(l_quantity), 2) AS q FROM lineitem", lambda t: op.global_aggregate(t.lineitem, v=aggregate("SUM", "l_linenumber"), q=F.round(aggregate("SUM", "l_quantity"), 2)))
_total("agg_count", "SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000", lambda t: op.global_aggregate(op.select(t.orders, c("o_totalprice") > 100000), n=aggregate("COUNT", "*")))
_total("agg_count_col", "SELECT count(o_custkey) AS n FROM orders", lambda t: op.global_aggregate(t.orders, n=aggregate("COUNT", "o_custkey")))
_total("agg_min", "SELECT min(o_totalprice) AS v, min(o_orderkey) AS k FROM orders", lambda t: op.global_aggregate(t.orders, v=aggregate("MIN", "o_totalprice"), k=aggregate("MIN", "o_orderkey")))
_total("agg_max", "SELECT max(o_totalprice) AS v, max(o_orderkey) AS k FROM orders", lambda t: op.global_aggregate(t.orders, v=aggregate("MAX", "o_totalprice"), k=aggregate("MAX", "o_orderkey")))
_total("agg_avg", "SELECT round(avg(l_extendedprice), 4) AS v, round(avg(l_linenumber), 6) AS n FROM lineitem", lambda t: op.global_aggregate(t.lineitem, v=F.round(aggregate("AVG", "l_extendedprice"), 4), n=F.round(aggregate("AVG", "l_linenumber"), 6)))
_total("agg_min_max_date", "SELECT CAST(min(l_shipdate) AS DATE) AS lo, CAST(max(l_shipdate) AS DATE) AS hi FROM lineitem", lambda t: op.global_aggregate(t.lineitem, lo=aggregate("MIN", "l_shipdate").cast("date"), hi=aggregate("MAX", "l_shipdate").cast("date")))
_total("agg_min_max_string", "SELECT min(c_name) AS lo, max(c_mktsegment) AS hi FROM customer", lambda t: op.global_aggregate(t.customer, lo=aggregate("MIN", "c_name"), hi=aggregate("MAX", "c_mktsegment")))
_total("agg_empty_input", "SELECT count(*) AS n, min(o_orderkey) AS lo FROM orders WHERE o_totalprice < 0", lambda t: op.global_aggregate(op.select(t.orders, c("o_totalprice") < 0), n=aggregate("COUNT", "*"), lo=aggregate("MIN", "o_orderkey")))
_total("agg_expr", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS v, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, round(sum(l_quantity) + 1, 2) AS more FROM lineitem", lambda t: op.global_aggregate(t.lineitem, v=F.round(aggregate("SUM", c("l_extendedprice") * (1 - c("l_discount"))), 2), returned=aggregate("SUM", F.when(c("l_returnflag") == "R", 1).otherwise(0)), more=F.round(aggregate("SUM", "l_quantity") + 1, 2)))
_total("agg_over_join", "SELECT CAST(sum(c_custkey * 2) AS BIGINT) AS v, round(avg(o_totalprice), 4) AS a FROM customer, orders WHERE c_custkey = o_custkey", lambda t: op.global_aggregate(op.equi_join(t.customer, t.orders, [("c_custkey", "o_custkey")]), v=aggregate("SUM", wide("c_custkey") * 2), a=F.round(aggregate("AVG", "o_totalprice"), 4)))


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY o_orderpriority")
def group_by_1(t):
    return op.group_by(t.orders, ["o_orderpriority"], n=aggregate("COUNT", "*"), v=F.round(aggregate("SUM", "o_totalprice"), 2))


@query("SELECT l_returnflag, l_linestatus, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_by_2(t):
    return op.group_by(t.lineitem, ["l_returnflag", "l_linestatus"], lo=aggregate("MIN", "l_quantity"), hi=aggregate("MAX", "l_quantity"), mean=F.round(aggregate("AVG", "l_quantity"), 6))


@query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber")
def group_by_3(t):
    return op.group_by(t.lineitem, ["l_returnflag", "l_linestatus", "l_linenumber"], n=aggregate("COUNT", "*"))


@query("SELECT count(*) AS n FROM orders GROUP BY o_orderstatus")
def group_by_no_key_out(t):
    return op.group_by(t.orders, ["o_orderstatus"], keep_keys=False, n=aggregate("COUNT", "*"))


@query("SELECT n_name, round(sum(c_acctbal), 2) AS v, CAST(sum(n_regionkey * c_nationkey) AS BIGINT) AS w FROM customer, nation WHERE c_nationkey = n_nationkey GROUP BY n_name")
def group_by_join(t):
    return op.group_by(op.equi_join(t.customer, t.nation, [("c_nationkey", "n_nationkey")]), ["n_name"], v=F.round(aggregate("SUM", "c_acctbal"), 2), w=aggregate("SUM", wide("n_regionkey") * wide("c_nationkey")))


@query("SELECT span, count(*) AS n FROM (SELECT l_orderkey, l_linenumber - 3 AS span FROM lineitem) x GROUP BY span")
def group_by_derived(t):
    return op.group_by(op.derived(op.project(t.lineitem, "l_orderkey", span=wide("l_linenumber") - 3), "x"), ["x.span"], n=aggregate("COUNT", "*"))


# ---- order, limit, unions, derived tables


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderstatus ASC, o_custkey DESC, o_orderkey")
def order_by_asc_desc(t):
    return op.order_by(t.orders, c("o_orderstatus").asc(), c("o_custkey").desc(), "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def order_by_unselected(t):
    return op.order_by(t.orders, c("o_totalprice").desc(), "o_orderkey").select("o_custkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY l_partkey - l_suppkey DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice")
def order_by_expr(t):
    return op.order_by(t.lineitem, (wide("l_partkey") - wide("l_suppkey")).desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10")
def limit(t):
    return op.limit(op.order_by(t.customer, "c_custkey"), 10).select("c_custkey")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 25")
def limit_offset(t):
    return t.sql("SELECT c_custkey FROM {customer} ORDER BY c_custkey LIMIT 25, 10", "customer")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7")
def top_k(t):
    return op.top_k(t.customer, 7, c("c_acctbal").desc(), "c_custkey").select("c_custkey", "c_acctbal")


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey AS k FROM supplier")
def union_all(t):
    return op.union_all(t.customer.select(c("c_nationkey").alias("k")), t.supplier.select(c("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
def union_distinct(t):
    return op.union_distinct(t.customer.select(c("c_nationkey").alias("k")), t.supplier.select(c("s_nationkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier UNION SELECT n_regionkey AS k FROM nation")
def union_three(t):
    return op.union_distinct(t.customer.select(c("c_nationkey").alias("k")), t.supplier.select(c("s_nationkey").alias("k")), t.nation.select(c("n_regionkey").alias("k")))


_PAREN = "(SELECT n_name AS v FROM {nation}) UNION (SELECT r_name AS v FROM {region})"


@query(_PAREN.replace("{", "").replace("}", ""))
def union_paren(t):
    return t.sql(_PAREN, "nation", "region")


@query("SELECT x.k, x.v FROM (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY o_custkey) x WHERE x.v > 200000")
def derived_table(t):
    x = op.derived(op.group_by(t.orders, [c("o_custkey").alias("k")], v=F.round(aggregate("SUM", "o_totalprice"), 2)), "x")
    return op.select(x, c("x.v") > 200000).select("x.k", "x.v")


_NESTED = """
SELECT a_name, b_name FROM (
  SELECT a.c_name AS a_name, b.c_name AS b_name, a.c_acctbal AS a_bal, b.c_acctbal AS b_bal
  FROM (SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM {customer}) a,
       (SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM {customer}) b
  WHERE a.c_nationkey = b.c_nationkey AND a.c_custkey <> b.c_custkey) sub
WHERE a_bal < b_bal AND a_name > b_name
"""


@query(_NESTED.replace("{", "").replace("}", ""))
def nested_derived(t):
    pairs = self_join(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_nationkey"), "a", "b", ["c_nationkey"], "a_c_custkey <> b_c_custkey")
    sub = op.derived(op.project(pairs, a_name=c("a_c_name"), b_name=c("b_c_name"), a_bal=c("a_c_acctbal"), b_bal=c("b_c_acctbal")), "sub")
    return op.select(sub, c("sub.a_bal") < c("sub.b_bal"), c("sub.a_name") > c("sub.b_name")).select("sub.a_name", "sub.b_name")


_SUBJOIN = "SELECT s_suppkey, r_name FROM ({nation} JOIN {region} ON n_regionkey = r_regionkey) JOIN {supplier} ON s_nationkey = n_nationkey"


@query(_SUBJOIN.replace("{", "").replace("}", ""))
def join_in_brackets(t):
    return t.sql(_SUBJOIN, "nation", "region", "supplier")


_DIVIDE = "SELECT o_orderkey, o_custkey / 4 AS part, round(o_totalprice / (1 + o_custkey), 6) AS share FROM {orders}"


@query(_DIVIDE.replace("{", "").replace("}", ""))
def divide(t):
    return t.sql(_DIVIDE, "orders")


# ---- kept results, files, stores


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000")
def cache_memory(t):
    return op.cached(op.select(t.orders, c("o_totalprice") > 100000).select("o_orderkey", "o_custkey"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000")
def cache_disk(t):
    return op.on_disk(op.select(t.orders, c("o_totalprice") > 100000).select("o_orderkey", "o_custkey"))


@query("SELECT n_nationkey || '|' || n_name || '|' || n_regionkey AS value FROM nation")
def result_lines(t):
    return lines(t.nation.select("n_nationkey", "n_name", "n_regionkey"))


_SUPPLIER = "CREATE TABLE supplier (s_suppkey int, s_name varchar(25), s_nationkey int, s_acctbal decimal, PRIMARY KEY (s_suppkey), INDEX (s_nationkey))"


def _ingested(t: Tables, stored: bool) -> Engine:
    """An engine that read suppliers from a delimited file."""
    folder = _folder(t.spark, "files")
    write_delimited(t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), f"{folder}/supplier.csv")
    engine = Engine(t.spark, folder, f"{folder}/store" if stored else None)
    engine.sql(_SUPPLIER)
    return engine


_RICH = "SELECT s_suppkey, s_name, s_nationkey + 0 AS s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0"


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def ingest_delimited(t):
    return _ingested(t, stored=False).sql(_RICH)


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def store_and_load(t):
    later = Engine(t.spark, "nowhere", _ingested(t, stored=True).stored)
    later.load()
    return later.sql(_RICH)


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name FROM supplier WHERE s_suppkey = 7")
def primary_key_lookup(t):
    return _ingested(t, stored=True).sql("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey = 7")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(min(s_suppkey) AS VARCHAR) AS least, CAST(max(s_suppkey) AS VARCHAR) AS most FROM supplier")
def saved_statistics(t):
    later = Engine(t.spark, "nowhere", _ingested(t, stored=True).stored)
    later.load()
    known = later.catalog.tables["SUPPLIER"]
    return t.spark.createDataFrame([(known.rows, *known.bounds["s_suppkey"])], "n long, least string, most string")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS v FROM lineitem GROUP BY l_returnflag, l_linestatus")
def sort_group_by(t):
    return _engine(t, "lineitem", in_memory=False).sql("SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_linenumber) AS v FROM lineitem GROUP BY l_returnflag, l_linestatus")


# ---- changes


def _engine(t: Tables, *names: str, stored: str | None = None, in_memory: bool = True) -> Engine:
    """An engine that has some of the tables."""
    engine = Engine(t.spark, "nowhere", stored, in_memory)
    own = Tables(engine.spark, t.folder)
    for name in names:
        engine.catalog.add_frame(name, getattr(own, name))
    return engine


def _changed(t: Tables, name: str, *statements: str) -> DataFrame:
    """A table after some statements, with its own types."""
    engine = _engine(t, name)
    for s in statements:
        engine.sql(s)
    return engine.catalog.table(name).select(*(c(f.name).cast(f.dataType) for f in getattr(t, name).schema))


@query("SELECT * FROM region UNION ALL VALUES (90, 'ATLANTIS'), (91, 'MU')")
def insert_delta(t):
    return _changed(t, "region", "INSERT INTO region(r_regionkey, r_name) VALUES (90, 'ATLANTIS')", "INSERT INTO region(r_regionkey, r_name) VALUES (91, 'MU')")


@query("SELECT * FROM nation WHERE NOT (n_regionkey = 1 OR n_name = 'CHINA')")
def delete_filter(t):
    return _changed(t, "nation", "DELETE FROM nation WHERE n_regionkey = 1 OR nation.n_name = 'CHINA'")


@query("SELECT * FROM (SELECT * FROM region UNION ALL VALUES (90, 'ATLANTIS')) x WHERE r_regionkey < 3")
def insert_then_delete(t):
    return _changed(t, "region", "INSERT INTO region(r_name, r_regionkey) VALUES ('ATLANTIS', 90)", "DELETE FROM region WHERE r_regionkey >= 3")


@query("SELECT * FROM region WHERE r_regionkey < 3 UNION ALL VALUES (90, 'ATLANTIS')")
def delete_then_insert(t):
    return _changed(t, "region", "DELETE FROM region WHERE r_regionkey >= 3", "INSERT INTO region(r_regionkey, r_name) VALUES (90, 'ATLANTIS')")


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 'moved' ELSE s_name END AS s_name, CASE WHEN s_nationkey = 3 THEN s_nationkey + 1 ELSE s_nationkey END AS s_nationkey FROM supplier")
def update_rows(t):
    return _changed(t, "supplier", "UPDATE supplier SET s_name = 'moved', s_nationkey = s_nationkey + 1 WHERE s_nationkey = 3").select("s_suppkey", "s_name", "s_nationkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT (CAST(o_orderkey AS BIGINT) * 1000000 + o_custkey > 5000000000)")
def delete_by_wide_numbers(t):
    return _changed(t, "orders", "DELETE FROM orders WHERE o_orderkey * 1000000 + o_custkey > 5000000000").select("o_orderkey", "o_custkey")


@query("SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN CAST(o_custkey AS BIGINT) * 10000000 > 6000000000 THEN CAST(o_custkey AS BIGINT) * 10000000 ELSE o_custkey END AS o_custkey FROM orders")
def update_to_wide_numbers(t):
    engine = _engine(t, "orders")
    engine.sql("UPDATE orders SET o_custkey = o_custkey * 10000000 WHERE o_custkey * 10000000 > 6000000000")
    return engine.sql("SELECT o_orderkey, o_custkey FROM orders")


# ---- views and key lookups


_temporary: list[str] = []
_folders: list[tuple[SparkSession, str]] = []


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder: in the one that all machines share, or, in a local session without one, a temporary one."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if place is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all machines")
        place = tempfile.mkdtemp(prefix="tessera")
        _temporary.append(place)
    out = f"{place.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex[:12]}"
    _folders.append((spark, out))
    return out


@atexit.register
def _remove() -> None:
    for spark, place in _folders:
        with contextlib.suppress(Exception):  # the JVM may be gone at exit
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for place in _temporary:
        shutil.rmtree(place, ignore_errors=True)


_with_views: dict[tuple[str, str, str], Engine] = {}


def _views(t: Tables, select: str) -> Engine:
    """An engine with a view of a SELECT by the year of l_shipdate; the view is built once for each application and folder of tables."""
    key = (t.spark.sparkContext.applicationId, t.folder, select)
    if key not in _with_views:
        engine = _engine(t, "lineitem", stored=_folder(t.spark, "views"))
        engine.build_view(select, "l_shipdate")
        _with_views[key] = engine
    return _with_views[key]


_WHOLE = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_returnflag, l_shipdate FROM lineitem"
_FEW = f"{_WHOLE} WHERE l_quantity < 25.0"
_LINES = "CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity"


@query(f"SELECT {_LINES} FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'")
def view_year_range(t):
    return _views(t, _WHOLE).sql("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'")


@query(f"SELECT {_LINES} FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_quantity < 10")
def view_residual(t):
    return _views(t, _FEW).sql("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_quantity < 10")


@query(f"SELECT {_LINES} FROM lineitem WHERE l_quantity < 30")
def view_no_match(t):
    return _views(t, _FEW).sql("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 30")


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount > 0.01 AND l_discount < 0.03 AND l_quantity < 25")
def view_aggregate(t):
    return _views(t, _FEW).sql(_Q6.replace("{", "").replace("}", ""))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def point_lookup(t):
    return op.select(t.orders, c("o_orderkey") == 77).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 180 AND o_orderstatus <> 'P'")
def range_lookup(t):
    return op.select(t.orders, c("o_orderkey") >= 100, c("o_orderkey") < 180, c("o_orderstatus") != "P").select("o_orderkey", "o_custkey")


# ---- the benchmark's shapes


_Q1 = """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM {lineitem} WHERE l_shipdate <= DATE '1999-02-08' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus
"""
_Q3 = """
SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(o_orderdate AS DATE) AS o_orderdate
FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1997-03-30' AND l_shipdate > DATE '1997-03-30'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10
"""
_Q5 = """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM {region}, {nation}, {customer}, {orders}, {lineitem}, {supplier}
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = n_nationkey AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'AFRICA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'
GROUP BY n_name ORDER BY revenue DESC
"""
_Q6 = """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem}
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount > 0.01 AND l_discount < 0.03 AND l_quantity < 25
"""
_Q12 = """
SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM {lineitem}, {orders} WHERE o_orderkey = l_orderkey AND (l_returnflag = 'R' OR l_returnflag = 'A') AND o_orderdate < l_shipdate
  AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY l_returnflag ORDER BY l_returnflag
"""


def _tpch(name: str, text: str, *tables: str) -> None:
    def f(t):
        return t.sql(text, *tables)

    f.__name__ = name
    query(text.replace("{", "").replace("}", ""))(f)


_tpch("tpch_q1", _Q1, "lineitem")
_tpch("tpch_q3", _Q3, "customer", "orders", "lineitem")
_tpch("tpch_q5", _Q5, "region", "nation", "customer", "orders", "lineitem", "supplier")
_tpch("tpch_q6", _Q6, "lineitem")
_tpch("tpch_q12_adapted", _Q12, "lineitem", "orders")
