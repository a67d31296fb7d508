"""Unions of two or more inputs, column by column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*dfs: DataFrame) -> DataFrame:
    """All rows of all inputs, duplicates too."""
    return reduce(DataFrame.union, dfs)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    """SQL's UNION: each row once."""
    return union_all(*dfs).distinct()
