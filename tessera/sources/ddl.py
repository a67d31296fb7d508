"""CREATE TABLE statements: columns, PRIMARY KEY and INDEX clauses."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..types import spark_type

_CREATE = re.compile(r"\s*CREATE\s+TABLE\s+(\w+)\s*\((.*)\)\s*;?\s*$", re.I | re.S)
_KEY = re.compile(r"\s*PRIMARY\s+KEY\s*\((.*)\)\s*$", re.I | re.S)
_INDEX = re.compile(r"\s*INDEX\s*(\w*)\s*\((.*)\)\s*$", re.I | re.S)


@dataclass
class Table:
    name: str
    schema: T.StructType
    primary_key: list[str] = field(default_factory=list)
    indexes: list[list[str]] = field(default_factory=list)
    #: Of a saved table: its rows, and the smallest and largest value of each column, as text.
    rows: int | None = None
    bounds: dict[str, list] = field(default_factory=dict)


def split_outside(text: str, sep: str) -> list[str]:
    """Splits at sep where it is outside of quotes and brackets."""
    parts, depth, quote, at = [""], 0, "", 0
    while at < len(text):
        c = text[at]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        if c == sep and not quote and depth == 0:
            parts.append("")
        else:
            parts[-1] += c
        at += 1
    return parts


def parse_create(statement: str) -> Table:
    m = _CREATE.match(statement)
    if not m:
        raise ValueError(f"not a table definition: {statement[:80]}")
    table = Table(m[1], T.StructType())
    for item in split_outside(m[2], ","):
        if k := _KEY.match(item):
            table.primary_key = [x.strip() for x in k[1].split(",")]
        elif k := _INDEX.match(item):
            table.indexes.append([x.strip() for x in k[2].split(",")])
        else:
            name, _, kind = item.strip().partition(" ")
            table.schema.add(name, spark_type(kind), True)
    return table
