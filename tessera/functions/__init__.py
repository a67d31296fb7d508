"""Scalar and aggregate functions by name."""

from .aggregates import AGGREGATES, aggregate
from .scalars import SCALARS, scalar

__all__ = ["AGGREGATES", "SCALARS", "aggregate", "scalar"]
