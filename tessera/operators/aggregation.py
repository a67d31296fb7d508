"""Global and grouped aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame


def global_aggregate(df: DataFrame, **aggregates: Column) -> DataFrame:
    """One row, also for an empty input (COUNT 0, the others null)."""
    return df.agg(*(c.alias(k) for k, c in aggregates.items()))


def group_by(df: DataFrame, keys: list[str | Column], *, keep_keys: bool = True, **aggregates: Column) -> DataFrame:
    """One row for each group, with or without its keys. Keys are compared by type and value; rows are combined before the shuffle."""
    out = df.groupBy(*keys).agg(*(c.alias(k) for k, c in aggregates.items()))
    return out if keep_keys else out.select(*aggregates)
