"""Inner joins. The strategy functions give hints; the results are the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = list[tuple[str, str]]
#: Keys that a look-up join sends to the inner table's scan.
LOOKUPS = 1_000
#: Rows of a grid join's block; a cell has the square of it in pairs at most.
BLOCK = 10_000
#: Rows for each task of a grid join, on average, at most.
COPIES = 1_000_000


def _on(left: DataFrame, right: DataFrame, keys: Keys) -> Column:
    return reduce(lambda a, b: a & b, (left[a] == right[b] for a, b in keys))


def equi_join(left: DataFrame, right: DataFrame, keys: Keys, residual: Column | None = None) -> DataFrame:
    """Rows whose typed keys are equal. Spark broadcasts a side that is measured to be small, else merges sorted runs, and splits skewed keys."""
    on = _on(left, right, keys)
    return left.join(right, on if residual is None else on & residual)


def hash_join(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    """Shuffles both sides by the keys and builds hash tables of the left one's partitions."""
    return left.hint("shuffle_hash").join(right, _on(left, right, keys))


def sort_merge_join(left: DataFrame, right: DataFrame, keys: Keys) -> DataFrame:
    return left.hint("merge").join(right, _on(left, right, keys))


def block_nested_loop_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Any condition: every pair is tried, partition of the left side by partition of the right one, none of which must fit anywhere whole."""
    return left.hint("shuffle_replicate_nl").join(right, condition)


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def theta_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Any condition. Spark joins by what equalities it has, else broadcasts a side that is measured to be small, else tries every pair."""
    return left.join(right, condition)


def index_lookup_join(outer: DataFrame, inner: DataFrame, keys: Keys) -> DataFrame:
    """Looks up the outer rows' keys in the inner table. Up to LOOKUPS keys are sent to its scan, which skips files and
    row groups by their bounds (a stored table is sorted by its key); more keys are an equi-join."""
    first, column = keys[0]
    wanted = outer.select(first).distinct().limit(LOOKUPS + 1).collect()
    if len(wanted) <= LOOKUPS:
        inner = inner.filter(inner[column].isin([r[0] for r in wanted if r[0] is not None]))
    return outer.join(inner, _on(outer, inner, keys))


def grid_join(left: DataFrame, right: DataFrame, keys: Keys, residual: Column) -> DataFrame:
    """An equi-join for keys that may have many rows on both sides. A key's rows are cut into blocks of at most BLOCK rows, every two
    blocks are a cell, and cells are dealt out to as many tasks as their pairs need: more pairs make more tasks, not longer ones.
    The sides have no column name in common. All their columns are copied to the cells, so give only those that are needed."""
    if both := set(left.columns) & set(right.columns):
        raise ValueError(f"columns of both sides: {sorted(both)}")
    own, other = ([k[i] for k in keys] for i in (0, 1))
    n, m = (df.groupBy(*(F.col(k).alias(f"_{of}{i}") for i, k in enumerate(names))).agg(F.count("*").alias(f"_{of}")) for df, of, names in ((left, "n", own), (right, "m", other)))
    blocks = [F.ceil(F.col(f"_{of}") / BLOCK).alias(name) for of, name in (("n", "_down"), ("m", "_across"))]
    start = F.hash(*(f"_n{i}" for i in range(len(keys)))).cast("long").alias("_start")
    sizes = n.join(m, _on(n, m, [(f"_n{i}", f"_m{i}") for i in range(len(keys))])).select("*", *blocks, start)
    pairs, copies = (x or 0 for x in sizes.agg(F.expr("sum(double(_n) * _m)"), F.expr("sum(double(_n) * _across + double(_m) * _down)")).first())
    few = min(10 * pairs // BLOCK**2, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tasks = 1 + int(max(few, pairs // BLOCK**2, copies // COPIES))

    def cells(df: DataFrame, names: list[str], of: str, block: str, blocks: str, every: str, others: str) -> DataFrame:
        """The rows of one side, in each cell of their block. They are numbered by what is in them, so that a task that is run again cuts the same blocks."""
        rows = df.withColumn("_row", F.row_number().over(Window.partitionBy(*names).orderBy(*df.columns)))
        rows = rows.join(sizes, _on(rows, sizes, [(k, f"_{of}{i}") for i, k in enumerate(names)]))
        rows = rows.withColumn(block, F.expr(f"(_row - 1) * {blocks} div _{of}")).repartition(*names, block)
        rows = rows.withColumn(every, F.explode(F.expr(f"sequence(0L, {others} - 1)"))).withColumn("_task", F.expr(f"int(pmod(_start + _i * _across + _j, {tasks}L))"))
        return rows.repartitionById(tasks, F.col("_task")).select(*df.columns, *(F.col(x).alias(f"_{of}{x}") for x in ("_task", "_i", "_j")))

    down, across = cells(left, own, "n", "_i", "_down", "_j", "_across"), cells(right, other, "m", "_j", "_across", "_i", "_down")
    on = _on(down, across, [*((f"_n{x}", f"_m{x}") for x in ("_task", "_i", "_j")), *keys])
    return down.join(across.hint("shuffle_hash"), on & residual).select(*left.columns, *right.columns)


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equates the columns of equal names and keeps one copy of each; without any, it is every pair, as in SQL."""
    common = [c for c in left.columns if c in right.columns]
    return left.join(right, common) if common else left.crossJoin(right)


def self_join(df: DataFrame, a: str, b: str, keys: list[str], condition: str) -> DataFrame:
    """A table with itself where the keys are equal; its columns are named a_... and b_..., and the condition is SQL over them."""
    left, right = (df.select(*(F.col(c).alias(f"{x}_{c}") for c in df.columns)) for x in (a, b))
    return grid_join(left, right, [(f"{a}_{k}", f"{b}_{k}") for k in keys], F.expr(condition))
