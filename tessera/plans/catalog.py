"""Tables by name: definitions, stored rows, and what changes have made of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store
from ..sources.ddl import Table
from ..types import compute_type
from . import dml

#: Steps over inserted rows after which they are computed and kept as rows.
STEPS = 16


@dataclass
class State:
    """A table after some changes: stored rows with the plan of deletes and updates, inserted rows likewise, and inserts not yet rows."""

    base: DataFrame
    added: DataFrame | None = None
    waiting: list[dml.Insert] = field(default_factory=list)
    steps: int = 0
    changed: bool = False

    def apply(self, change: dml.Change) -> State:
        """The next state. One step is added to each plan, however many statements there were."""
        if isinstance(change, dml.Insert):
            dml.check_insert(self.base, change)
            return State(self.base, self.added, [*self.waiting, change], self.steps, True)
        added, steps = self.inserted(), self.steps + 1
        if added is not None:
            added = dml.step(added, change)
            if steps >= STEPS:  # as many rows as statements gave
                added, steps = added.sparkSession.createDataFrame(added.collect(), added.schema), 0
        return State(dml.step(self.base, change), added, [], steps, True)

    def inserted(self) -> DataFrame | None:
        new = dml.inserted(self.base, self.waiting) if self.waiting else None
        return self.added if new is None else new if self.added is None else self.added.unionByName(new)

    def table(self) -> DataFrame:
        added = self.inserted()
        return self.base if added is None else self.base.unionByName(added)


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, Table] = {}
        self.states: dict[str, State] = {}
        self.stale: set[str] = set()

    def add(self, table: Table, df: DataFrame) -> None:
        """Whole numbers have 64 bits from here on, in conditions and new values too."""
        key = table.name.upper()
        wide = df.select(*(F.col(f"`{f.name}`").cast(compute_type(f.dataType)).alias(f.name) for f in df.schema))
        self.tables[key], self.states[key] = table, State(wide)
        self.stale.add(key)

    def add_frame(self, name: str, df: DataFrame) -> None:
        """A table that is there already, as a DataFrame."""
        self.add(Table(name, df.schema), df)

    def change(self, change: dml.Change) -> None:
        key = change.table.upper()
        if key not in self.tables:
            raise ValueError(f"unknown table: {change.table}")
        self.states[key] = self.states[key].apply(change)
        self.stale.add(key)

    def table(self, name: str) -> DataFrame:
        """The table as its changes have left it."""
        return self.states[name.upper()].table()

    def changed(self, name: str) -> bool:
        return self.states[name.upper()].changed

    def publish(self) -> None:
        """Makes the tables visible to SELECTs; only those that changed since are planned again."""
        for key in self.stale:
            self.table(key).createOrReplaceTempView(self.tables[key].name)
        self.stale.clear()

    def load(self, folder: str) -> list[str]:
        """Adds all tables saved in a folder."""
        found = store.definitions(self.spark, folder)
        for t in found:
            self.add(t, store.load(self.spark, t, folder))
        return [t.name for t in found]
