"""Statements of a script, one by one, and what Spark's SQL spells differently."""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..sources.ddl import split_outside

_LIMIT = re.compile(r"\bLIMIT\s+(\d+)\s*,\s*(\d+)", re.I)


def statements(script: str) -> Iterator[str]:
    for s in split_outside(script, ";"):
        if s.strip():
            yield s.strip()


def kind(statement: str) -> str:
    words = statement.lstrip(" (\n\t").upper().split(None, 2)
    if words[:1] in (["SELECT"], ["INSERT"], ["DELETE"], ["UPDATE"]):
        return words[0]
    return "CREATE" if words[:2] == ["CREATE", "TABLE"] else ""


def spark_select(statement: str) -> str:
    """LIMIT offset, count becomes LIMIT count OFFSET offset, outside of quotes."""
    parts = re.split(r"('(?:[^']|'')*')", statement)
    return "".join(p if i % 2 else _LIMIT.sub(r"LIMIT \2 OFFSET \1", p) for i, p in enumerate(parts))
