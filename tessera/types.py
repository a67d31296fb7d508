"""Column types of table definitions and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: The type words of table definitions.
TYPES: dict[str, T.DataType] = {
    "int": T.IntegerType(),
    "decimal": T.DoubleType(),
    "float": T.DoubleType(),
    "string": T.StringType(),
    "char": T.StringType(),
    "varchar": T.StringType(),
    "date": T.DateType(),
}


def spark_type(word: str) -> T.DataType:
    """The Spark type of a type word; a length or precision in brackets has no effect."""
    name = re.sub(r"\s*\(.*\)\s*$", "", word).strip().lower()
    if name not in TYPES:
        raise ValueError(f"unknown data type: {word}")
    return TYPES[name]


def compute_type(kind: T.DataType) -> T.DataType:
    """The type that arithmetic uses: whole numbers have 64 bits."""
    return T.LongType() if isinstance(kind, T.IntegerType) else kind
