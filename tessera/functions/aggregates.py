"""The five aggregates, by case-insensitive name.

SUM of whole numbers is a whole number, of others a double; AVG is a double;
MIN and MAX order numbers, strings and dates; COUNT(col) leaves nulls out.
Spark aggregates in two phases by itself: partial before the shuffle, final after.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

AGGREGATES: dict[str, Callable[[Column | str], Column]] = {"SUM": F.sum, "COUNT": F.count, "MIN": F.min, "MAX": F.max, "AVG": F.avg}


def aggregate(name: str, value: Column | str) -> Column:
    if name.upper() not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {name}")
    return AGGREGATES[name.upper()](value)
