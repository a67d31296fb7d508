"""Results kept to be read again, in memory or on disk; both spill or recompute, so neither must fit."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def cached(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def on_disk(df: DataFrame) -> DataFrame:
    return df.persist(StorageLevel.DISK_ONLY)
