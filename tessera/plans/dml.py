"""INSERT, DELETE and UPDATE as an ordered log over immutable tables.

A statement acts on the rows that were there before it: a DELETE takes earlier
inserts but not later ones. Each DELETE and UPDATE is one more step of a
DataFrame plan; inserts in a row become one local relation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.ddl import split_outside

_INSERT = re.compile(r"\s*INSERT\s+INTO\s+(\w+)\s*(?:\(([^)]*)\))?\s*VALUES\s*(.*?)\s*;?\s*$", re.I | re.S)
_DELETE = re.compile(r"\s*DELETE\s+FROM\s+(\w+)(?:\s+WHERE\s+(.*?))?\s*;?\s*$", re.I | re.S)
_UPDATE = re.compile(r"\s*UPDATE\s+(\w+)\s+SET\s+(.*?)\s*;?\s*$", re.I | re.S)


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...]
    values: tuple[tuple[str, ...], ...]


@dataclass(frozen=True)
class Delete:
    table: str
    condition: str | None


@dataclass(frozen=True)
class Update:
    table: str
    sets: tuple[tuple[str, str], ...]
    condition: str | None


Change = Insert | Delete | Update


def parse_change(statement: str) -> Change:
    if m := _INSERT.match(statement):
        columns = tuple(c.strip() for c in m[2].split(",")) if m[2] else ()
        values = tuple(tuple(v.strip() for v in split_outside(row.strip()[1:-1], ",")) for row in split_outside(m[3], ",") if row.strip())
        return Insert(m[1], columns, values)
    if m := _DELETE.match(statement):
        return Delete(m[1], m[2])
    if m := _UPDATE.match(statement):
        sets, condition = _where(m[2])
        pairs = tuple((a.strip().split(".")[-1], b.strip()) for a, _, b in (x.partition("=") for x in split_outside(sets, ",")))
        return Update(m[1], pairs, condition)
    raise ValueError(f"not an INSERT, DELETE or UPDATE: {statement[:80]}")


def _where(text: str) -> tuple[str, str | None]:
    """Parts text at the first WHERE outside of quotes and brackets."""
    words, at = split_outside(text, " "), 0
    for w in words:
        if w.strip().upper() == "WHERE":
            return text[:at], text[at + len(w) :]
        at += len(w) + 1
    return text, None


def check_insert(df: DataFrame, change: Insert) -> None:
    columns = change.columns or tuple(df.columns)
    if any(len(v) != len(columns) for v in change.values):
        raise ValueError("as many values as columns are needed")
    if unknown := {c.lower() for c in columns} - {c.lower() for c in df.columns}:
        raise ValueError(f"unknown columns: {sorted(unknown)}")


def inserted(df: DataFrame, changes: list[Insert]) -> DataFrame:
    """The rows of some INSERTs, given as SQL literals, with the columns of df; those that are not named are null."""
    rows = []
    for change in changes:
        place = {c.lower(): i for i, c in enumerate(change.columns or df.columns)}
        rows += ["(" + ", ".join(v[place[c.lower()]] if c.lower() in place else "NULL" for c in df.columns) + ")" for v in change.values]
    given = df.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(rows)}").toDF(*df.columns)
    return given.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in df.schema))


def delete(df: DataFrame, table: str, condition: str | None) -> DataFrame:
    """The rows for which the condition is not true; unknown is not true."""
    return df.alias(table).filter(~F.coalesce(F.expr(condition), F.lit(False))) if condition else df.limit(0)


def update(df: DataFrame, table: str, sets: tuple[tuple[str, str], ...], condition: str | None) -> DataFrame:
    """All rows; where the condition is true, columns take their new values, computed from the old row."""
    new = {c.lower(): e for c, e in sets}
    if unknown := new.keys() - {c.lower() for c in df.columns}:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    hit = F.coalesce(F.expr(condition), F.lit(False)) if condition else F.lit(True)
    return df.alias(table).select(*((F.when(hit, F.expr(new[f.name.lower()])).otherwise(F.col(f.name)).cast(f.dataType) if f.name.lower() in new else F.col(f.name)).alias(f.name) for f in df.schema))


def step(df: DataFrame, change: Delete | Update) -> DataFrame:
    return delete(df, change.table, change.condition) if isinstance(change, Delete) else update(df, change.table, change.sets, change.condition)
