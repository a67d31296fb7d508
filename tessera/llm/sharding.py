"""Sharding by minimax contiguous partition of ordered atomic groups.

Groups (equal texts) are ordered by their smallest doc_id and range-partitioned;
each partition's ranks are written once. The smallest feasible capacity is found
by binary search, each candidate checked greedily: a shard takes groups while
they fit. The greedy check only needs "the last group whose running sum is at
most x". It is answered from an index of as many levels as needed: sums of runs
of groups, of which only those in which a cut can still lie are parted again,
by one aggregation on the executors, until they are single groups. The driver
gets one row for each partition, and at most ``rows`` for each level. No group
is cut.

Null and empty texts are one group. Null ids sort first; groups of the same
smallest id are ordered by their SHA-256. A very long text is one heavy group.
Repeated rows are rows of one group. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Sums that one level of the index adds, at most.
ROWS = 1 << 15


def greedy(last: Callable[[int], int], total: int, shards: int, capacity: int) -> list[int] | None:
    """Running sums at which shards 0, 1, ... end if each takes all that fits; None if that leaves a rest.

    last(x): the largest running sum of a group's end that is at most x.
    """
    ends, at = [], 0
    for _ in range(shards):
        at = last(at + capacity)
        ends.append(at)
        if at >= total:
            return ends
    return None


def smallest_capacity(last: Callable[[int], int], total: int, heaviest: int, shards: int, enough: int) -> int:
    """The smallest capacity at which the greedy check leaves no rest; ``enough`` is known to do."""
    lo, hi = max(heaviest, -(-total // shards)), enough
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy(last, total, shards, mid) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


@dataclass
class _Run:
    """Groups of one partition with ranks from first to beyond: their running sum's end."""

    end: int
    part: int
    first: int
    beyond: int

    def __len__(self) -> int:
        return self.beyond - self.first


class _Sums:
    """Runs of the written groups, in order, with their running sums."""

    def __init__(self, groups: DataFrame, rows: int):
        self.groups, self.rows = groups, rows
        self.runs, at = [], 0
        for part, n, weight in sorted(groups.groupBy("part").agg(F.count("*"), F.sum("weight")).collect()):  # one row for each partition
            at += weight
            self.runs.append(_Run(at, part, 0, n))
        self.ends = [r.end for r in self.runs]

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0

    def holding(self, x: int) -> int:
        """The index of the run in which, or at whose end, the running sum x lies."""
        return min(bisect.bisect_left(self.ends, x), len(self.ends) - 1)

    def low(self, x: int) -> int:
        """last(x) where runs are not cut: at most the true one."""
        i = bisect.bisect_right(self.ends, x)
        return self.ends[i - 1] if i else 0

    def high(self, x: int) -> int:
        """last(x) where runs of several groups are cut anywhere: at least the true one."""
        i = bisect.bisect_right(self.ends, x)
        at = self.ends[i - 1] if i else 0
        return max(at, x) if i < len(self.runs) and len(self.runs[i]) > 1 else at

    def part_again(self, wanted: list[int]) -> None:
        """Parts some runs into as many smaller ones as a level may add, in one job."""
        fan = max(2, self.rows // len(wanted))
        keys = [(i, self.runs[i].part, self.runs[i].first, self.runs[i].beyond, -(-len(self.runs[i]) // fan)) for i in wanted]
        spark = self.groups.sparkSession
        runs = F.broadcast(spark.createDataFrame(keys, "i long, run_part long, first_rank long, beyond long, step long"))
        mine = self.groups.filter(F.col("part").isin(sorted({k[1] for k in keys})) if len(keys) <= 100 else F.lit(True))
        mine = mine.join(runs, (F.col("part") == F.col("run_part")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("beyond")))
        found = sorted(mine.groupBy("i", F.floor((F.col("rank") - F.col("first_rank")) / F.col("step")).alias("j"), "step").agg(F.sum("weight")).collect())
        finer: dict[int, list[_Run]] = {}
        for i, j, step, weight in found:
            run, new = self.runs[i], finer.setdefault(i, [])
            at = new[-1].end if new else (self.ends[i - 1] if i else 0)
            new.append(_Run(at + weight, run.part, run.first + j * step, min(run.beyond, run.first + (j + 1) * step)))
        self.runs = [x for i, run in enumerate(self.runs) for x in finer.get(i, [run])]
        self.ends = [r.end for r in self.runs]

    def cuts(self, heaviest: int, shards: int) -> list[int]:
        """Running sums at which shards 0, 1, ... end at the smallest feasible capacity."""
        while True:
            enough = smallest_capacity(self.low, self.total, heaviest, shards, self.total)
            least = smallest_capacity(self.high, self.total, heaviest, shards, enough)
            wanted, lo, hi = set(), 0, 0
            for _ in range(shards):  # each cut at each capacity in question lies between these two
                lo, hi = self.low(lo + least), self.high(hi + enough)
                wanted |= {i for i in range(self.holding(min(lo + 1, self.total)), self.holding(hi) + 1) if len(self.runs[i]) > 1 and lo < self.total}
            if not wanted:
                return greedy(self.low, self.total, shards, enough)
            self.part_again(sorted(sorted(wanted, key=lambda i: -len(self.runs[i]))[: max(1, self.rows // 2)]))


def _ranked(part_col: str, by: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the task's number and the row's rank among the rows with equal ``by`` (all, if none); rows come sorted by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = TaskContext.get().partitionId(), {}
        for b in batches:
            if by:
                rank = []
                for key in zip(*(b.column(c).to_pylist() for c in by), strict=True):
                    rank.append(counts.get(key, 0))
                    counts[key] = rank[-1] + 1
                ranks = pa.array(rank, pa.int64())
            else:
                at = counts.get((), 0)
                ranks = pa.array(range(at, at + len(b)), pa.int64())
                counts[()] = at + len(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(b), pa.int64()), ranks], [*b.schema.names, part_col, "rank"])

    return run


def shard(docs: DataFrame, *, shards: int = 8, rows: int = ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; equal texts share a shard."""
    spark = docs.sparkSession
    common.ship(spark)
    scratch = common.Scratch(spark, "sharding")
    sized = common.texts(docs)
    sized = scratch.write(sized.select("doc_id", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32("text").alias("text_crc32"), F.sha2("text", 256).alias("digest")), "rows")
    weights = sized.groupBy("digest").agg(F.sum("size").alias("weight"), F.min("doc_id").alias("first"))
    heaviest, n = weights.agg(F.max("weight"), F.count("*")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = weights.repartitionByRange(parts, F.col("first").asc_nulls_first(), "digest").sortWithinPartitions(F.col("first").asc_nulls_first(), "digest")
    groups = scratch.write(ordered.mapInArrow(_ranked("part", []), "digest string, weight long, first long, part long, rank long"), "groups")
    sums = _Sums(groups, rows)
    cuts = sums.cuts(heaviest, shards)[:-1] if n else []
    placed = scratch.write(sized.join(_shards(groups, sums, cuts), "digest").select("doc_id", "size", "text_crc32", "shard"), "placed")
    return _slots(placed, parts, scratch).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _shards(groups: DataFrame, sums: _Sums, cuts: list[int]) -> DataFrame:
    """digest, shard: the number of cuts at or before the group, by comparing (part, rank) with the cuts' places."""
    shard = F.lit(0)
    for cut in cuts:
        run = sums.runs[sums.holding(cut)]  # cuts are ends of runs
        shard = shard + ((F.col("part") > run.part) | ((F.col("part") == run.part) & (F.col("rank") >= run.beyond))).cast("int")
    return groups.select("digest", shard.alias("shard"))


def _slots(placed: DataFrame, parts: int, scratch: common.Scratch) -> DataFrame:
    """placed with slot: gapless in each shard, in order of doc_id, by ranks within partitions and sums of the partitions before."""
    keys = ["shard", F.col("doc_id").asc_nulls_first(), "size", "text_crc32"]
    ranked = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_ranked("part", ["shard"]), "doc_id long, size long, text_crc32 long, shard int, part long, rank long")
    ranked = scratch.write(ranked, "ranked")
    counts = sorted(ranked.groupBy("shard", "part").count().collect())  # one row for each partition and shard at most
    bases, at = [], {}
    for s, p, c in counts:
        bases.append((s, p, at.get(s, 0)))
        at[s] = at.get(s, 0) + c
    base = placed.sparkSession.createDataFrame(bases, "shard int, part long, base long")
    return ranked.join(F.broadcast(base), ["shard", "part"]).withColumn("slot", F.col("base") + F.col("rank"))
