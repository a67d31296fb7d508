"""Delimited files in, rows out: '|' between values, no header, no quoting, dates yyyy-MM-dd."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELIMITER = "|"


def read_delimited(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed rows of a file or folder; a value that does not fit its type fails the read."""
    return spark.read.schema(schema).option("sep", DELIMITER).option("quote", "").option("mode", "FAILFAST").option("dateFormat", "yyyy-MM-dd").csv(path)


def lines(df: DataFrame) -> DataFrame:
    """One column, value: each row as its values with '|' between them; null is empty."""
    return df.select(F.concat_ws(DELIMITER, *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns)).alias("value"))


def rows(df: DataFrame) -> Iterable[str]:
    """The lines of a result, for printing, partition by partition."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return (r.value for r in lines(df.toDF(*names)).toLocalIterator())


def write_delimited(df: DataFrame, path: str) -> None:
    lines(df).write.mode("overwrite").text(path)
