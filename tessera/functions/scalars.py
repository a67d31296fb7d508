"""Scalar functions by case-insensitive name: DATE('yyyy-MM-dd') alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def date(text: str | Column) -> Column:
    return F.to_date(F.lit(text) if isinstance(text, str) else text, "yyyy-MM-dd")


SCALARS: dict[str, Callable[..., Column]] = {"DATE": date}


def scalar(name: str, *args) -> Column:
    if name.upper() not in SCALARS:
        raise ValueError(f"unknown function: {name}")
    return SCALARS[name.upper()](*args)


def wide(c: str | Column) -> Column:
    """A whole number as 64 bits, so that arithmetic on it does not overflow at 32."""
    return (F.col(c) if isinstance(c, str) else c).cast("long")
