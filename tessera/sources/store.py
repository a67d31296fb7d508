"""Tables as Parquet, with their definitions beside them, so that a later session can load them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ddl import Table


def save(df: DataFrame, table: Table, folder: str) -> DataFrame:
    """Writes a table in ranges of its primary key or first index, each file sorted, so that a look-up opens the files of one range; rows and bounds are saved with it."""
    keys = table.primary_key or (table.indexes[0] if table.indexes else [])
    (df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df).write.mode("overwrite").parquet(f"{folder}/{table.name}")
    spark = df.sparkSession
    found = statistics(load(spark, table, folder), *table.schema.names)
    bounds = {c: [None if x is None else str(x) for x in v] for c, v in found.items() if c != "rows"}
    state = {"name": table.name, "schema": table.schema.jsonValue(), "primary_key": table.primary_key, "indexes": table.indexes, "rows": found["rows"], "bounds": bounds}
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/_definitions/table={table.name}")
    return load(spark, table, folder)


def load(spark: SparkSession, table: Table, folder: str) -> DataFrame:
    return spark.read.schema(table.schema).parquet(f"{folder}/{table.name}")


def definitions(spark: SparkSession, folder: str) -> list[Table]:
    """The definitions of all saved tables."""
    found = [json.loads(r.value) for r in spark.read.text(f"{folder}/_definitions").select("value").collect()]
    return [Table(x["name"], T.StructType.fromJson(x["schema"]), x["primary_key"], x["indexes"], x.get("rows"), x.get("bounds", {})) for x in found]


def statistics(df: DataFrame, *columns: str) -> dict[str, object]:
    """Rows, and the smallest and largest value of columns, in one pass."""
    row = df.agg(F.count("*"), *(f(c) for c in columns for f in (F.min, F.max))).first()
    return {"rows": row[0]} | {c: (row[1 + 2 * i], row[2 + 2 * i]) for i, c in enumerate(columns)}
