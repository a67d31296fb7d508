"""Connected components of links between long ids, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) for each node of links (a, b).

    Alternates large-star and small-star steps (each node's smallest neighbour
    takes its larger, then its smaller neighbours) until the links are stars
    around the smallest nodes. Each step is an aggregate by node, combined
    before the shuffle for the minimum, and a join; its result is written.

    A link with a null end is none; repeated links count once, loops not at all;
    an empty table gives no rows.
    """
    edges = scratch.write(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), f"{name}_0")
    step, mark = 0, _mark(edges)
    while True:
        small = scratch.write(_star(_star(edges, larger=True), larger=False), f"{name}_{step + 1}")
        before, mark = mark, _mark(small)
        scratch.drop(f"{name}_{step}")
        if mark == before:
            break
        edges, step = small, step + 1
    return small.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(small.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """What tells two sets of links apart."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", F.lit(1), "a"))).first())


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links (a < b) after each node has handed its larger (or smaller) neighbours, and itself, to its smallest one."""
    if larger:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u")
    moved = moved.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")) if larger else moved.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return moved.filter("a < b").distinct()
