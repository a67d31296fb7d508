"""New delimited files of a folder as a stream, and a sink that appends them to a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.delimited import DELIMITER


def appended(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("sep", DELIMITER).option("quote", "").option("dateFormat", "yyyy-MM-dd").csv(folder)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what there is to a Parquet folder, each file once, and stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
