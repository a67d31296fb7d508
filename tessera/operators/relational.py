"""Projection, selection, derived tables, ordering and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, *items: str | Column, **named: Column) -> DataFrame:
    """The given columns, then the named expressions."""
    return df.select(*items, *(c.alias(k) for k, c in named.items()))


def table_star(df: DataFrame, alias: str) -> DataFrame:
    """All columns of one of the joined tables."""
    return df.select(f"{alias}.*")


def select(df: DataFrame, *conjuncts: Column) -> DataFrame:
    """The rows for which all conjuncts hold. Spark pushes them into the scan and below joins and unions."""
    return df.filter(reduce(lambda a, b: a & b, conjuncts)) if conjuncts else df


def derived(df: DataFrame, alias: str) -> DataFrame:
    """A subquery in FROM under a name."""
    return df.alias(alias)


def order_by(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.orderBy(*keys)


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(n)


def top_k(df: DataFrame, k: int, *keys: str | Column) -> DataFrame:
    """The first k rows by the keys: each task keeps k rows, no full sort."""
    return df.orderBy(*keys).limit(k)


def asc(c: str) -> Column:
    return F.col(c).asc()


def desc(c: str) -> Column:
    return F.col(c).desc()
