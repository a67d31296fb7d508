"""What the operators share: the shared folder, tables that cut lineage, shipping."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of the largest table that is sent to every task; more rows take the shuffled way.
BROADCAST_ROWS = 200_000
#: Java pattern of a run of word separators, and of one word.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"

#: Spark's setting that deletes the shuffle files of a query when it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the time of one query."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    place = os.path.join(folder, "tessera_llm_ship.zip")
    with zipfile.ZipFile(place, "w") as z:
        for here, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(here, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    sc.addPyFile(place)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    It is read from spark.checkpoint.dir. Only a local session without that
    setting, as in tests, gets a folder of its own; a cluster without it is an
    error, because a machine-local folder would lose data there.
    """
    conf = spark.sparkContext.getConf()
    place = conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder shared by all machines")
        place = _own_dir()
    return place if "://" in place or place.startswith("file:") else f"file://{place}"


_own: list[str] = []


def _own_dir() -> str:
    if not _own:
        folder = tempfile.TemporaryDirectory(prefix="tessera")
        atexit.register(folder.cleanup)
        _own.append(folder.name)
    return _own[0]


class Scratch:
    """Tables of one operator run, written to the shared folder.

    Each is Parquet, so losing an executor never recomputes what came before.
    ``drop`` deletes a table that nothing will read again; the rest goes with
    the driver.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tessera/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._drop, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """The table as a Parquet table; shuffle files that only its making needed go at once."""
        with _setting(self.spark, CLEANUP, "true"):
            df.write.mode("overwrite").parquet(self.path(name), compression=compression)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._drop(self.path(name))

    def _drop(self, place: str) -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone at exit
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, whatever else docs has: doc_id as long, text as UTF-8 bytes (null: empty)."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def carried(docs: DataFrame) -> DataFrame:
    """docs as one column, _row, so that no name of theirs meets one of ours."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col("_row").getField(c).alias(c) for c in columns))


def exact_copies(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Rows whose text, if it has a word, equals one with a smaller doc_id.

    Returns (keys of all rows: doc_id, digest; copies: doc_id, digest, rep; the
    number of copies). Only ids and digests are shuffled, with counts combined
    before the shuffle, so a text that a third of all rows share is no hot key.
    """
    keys = scratch.write(
        docs.select(
            "doc_id",
            F.sha2(F.col("text"), 256).alias("digest"),
            F.col("text").cast("string").rlike(WORD).alias("has_word"),
        ),
        "keys",
    )
    first = scratch.write(
        keys.filter("has_word and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n"),
        "first",
    )
    copies = scratch.write(keys.filter("has_word").join(first, "digest").filter("doc_id != rep").select("doc_id", "digest", "rep"), "copies")
    return keys, copies, copies.count()


def most_frequent(df: DataFrame, n: str, most: int) -> DataFrame:
    """Rows of df with the largest counts n >= 1, at most ``most`` of them, without a sort.

    The bound on n comes from a histogram of its logarithm, combined before the
    shuffle, so no task gets more than its share of df; rows of one bin of the
    histogram stay or go together.
    """
    bin_ = F.floor(F.log2(n) * 16).cast("int")
    bins = sorted(df.groupBy(bin_.alias("bin")).count().collect(), reverse=True)  # 1,024 rows at most
    least, total = None, 0
    for b, size in bins:
        if total + size > most:
            break
        least, total = b, total + size
    if len(bins) and least == bins[-1][0]:
        return df
    return df.limit(0) if least is None else df.filter(bin_ >= least)


def without(df: DataFrame, ids: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Rows of df whose key is not in ids, which has n rows; broadcast only up to BROADCAST_ROWS."""
    if n == 0:
        return df
    ids = ids.select(key).distinct()
    return df.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, key, "left_anti")


def within(df: DataFrame, ids: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """Rows of df whose key is in ids, which has n rows; broadcast only up to BROADCAST_ROWS."""
    ids = ids.select(key).distinct()
    return df.join(F.broadcast(ids) if n <= BROADCAST_ROWS else ids, key, "left_semi")
