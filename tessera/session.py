"""The engine: scripts of statements against a catalog of tables."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .plans import dml
from .plans.catalog import Catalog
from .plans.statements import kind, spark_select, statements
from .plans.views import View, ViewCatalog, needs, source
from .sources import store
from .sources.ddl import Table, parse_create
from .sources.delimited import read_delimited, rows


class Engine:
    """CREATE TABLE reads <data>/<NAME>.csv (any case); with a store, as Parquet written there once, and with a
    view by year for each indexed date column (the first one, if none is), which SELECTs then use.

    The engine has a session of its own: its settings and table names touch no other. in_memory prefers hash joins;
    otherwise joins merge sorted runs, and groups of sorted rows are formed without a hash table.
    """

    def __init__(self, spark: SparkSession, data: str = "data", stored: str | None = None, in_memory: bool = True):
        self.spark, self.data, self.stored = spark.newSession(), data.rstrip("/"), stored
        self.catalog = Catalog(self.spark)
        self.views = ViewCatalog(f"{stored}/views") if stored else None
        self.spark.conf.set("spark.sql.join.preferSortMergeJoin", str(not in_memory).lower())
        self.spark.conf.set("spark.sql.execution.replaceHashWithSortAgg", str(not in_memory).lower())

    def sql(self, statement: str) -> DataFrame | None:
        """Runs one statement; a SELECT's rows are returned, not computed yet."""
        what = kind(statement)
        if what == "SELECT":
            return self._select(spark_select(statement.rstrip().rstrip(";")))
        if what == "CREATE":
            self._create(parse_create(statement))
        elif what:
            self.catalog.change(dml.parse_change(statement))
        else:
            raise ValueError("Invalid Query")
        return None

    def _select(self, text: str) -> DataFrame:
        """The rows of a SELECT, from views where they serve; a table that was changed is read itself."""
        self.catalog.publish()
        if self.views is None:
            return self.spark.sql(text)
        names = {t.name: key for key, t in self.catalog.tables.items() if not self.catalog.changed(key)}

        def run(chosen: dict[str, DataFrame]) -> DataFrame:
            for name, df in chosen.items():
                df.createOrReplaceTempView(name)
            try:
                return self.spark.sql(text)  # names are resolved here
            finally:
                self.catalog.stale |= {names[name] for name in chosen}
                self.catalog.publish()

        return self.views.answer(run, {name: self.catalog.table(key) for name, key in names.items()})

    def build_view(self, select: str, date: str) -> View:
        """Keeps the columns and rows of a SELECT over one table, by the year of a date, for later SELECTs."""
        self.catalog.publish()
        df = self.spark.sql(select)
        (need,) = needs(df)
        (table,) = [t.name for key, t in self.catalog.tables.items() if source(self.catalog.table(key)) == need.path]
        return self.views.build(self.catalog.table(table), table, date, need.conjuncts, tuple(df.columns))

    def script(self, text: str) -> list[DataFrame]:
        """The results of the SELECTs among some statements."""
        return [df for s in statements(text) if (df := self.sql(s)) is not None]

    def explain(self, statement: str) -> str:
        df = self.sql(statement)
        return "" if df is None else df._jdf.queryExecution().toString()

    def load(self) -> list[str]:
        """The tables, and the views, that an earlier session stored."""
        self.views.load(self.spark)
        return self.catalog.load(self.stored)

    def _create(self, table: Table) -> None:
        df = read_delimited(self.spark, self._file(table.name), table.schema)
        self.catalog.add(table, store.save(df, table, self.stored) if self.stored else df)
        if self.stored:
            dates = [f.name for f in table.schema if isinstance(f.dataType, T.DateType)]
            for date in [d for d in dates if any(i[0] == d for i in table.indexes)] or dates[:1]:
                self.views.build(self.catalog.table(table.name), table.name, date)

    def _file(self, name: str) -> str:
        """The table's file, found by Hadoop's file systems, whatever the case of its name."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.data)
        files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
        found = sorted(f.getPath().toString() for f in files if f.getPath().getName().lower() == f"{name}.csv".lower())
        exact = [f for f in found if f.endswith(f"/{name}.csv")]
        if not found:
            raise FileNotFoundError(f"{self.data}/{name}.csv")
        return (exact or found)[0]

    def repl(self, source: TextIO, sink: TextIO, prompt: str = "$> ") -> None:
        """Reads statements up to ';' and prints results as lines of values with '|' between; an error is told and the loop goes on."""
        held = ""
        print(prompt, end="", file=sink, flush=True)
        for line in source:
            held += line
            if ";" not in line:
                continue
            *whole, held = _parts(held)
            for s in whole:
                try:
                    if (df := self.sql(s)) is not None:
                        for row in rows(df):
                            print(row, file=sink)
                except Exception as e:
                    print(f"Invalid Query: {str(e).splitlines()[0][:200]}", file=sys.stderr)
                print(prompt, end="", file=sink, flush=True)


def _parts(text: str) -> list[str]:
    from .sources.ddl import split_outside

    *whole, rest = split_outside(text, ";")
    return [*(s for s in whole if s.strip()), rest]
