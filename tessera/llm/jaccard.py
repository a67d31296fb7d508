"""N-gram Jaccard join by T-occurrence search, and groups of near copies.

Two sets of distinct 5-word shingles link when 100 |A & B| >= 75 |A | B|.

* Texts that are byte for byte equal to another are set aside; they join the
  group of the smallest id with that text.
* A set of n shingles can only link with one that is in T = ceil(0.75 n) of its
  n inverted lists at least. DivideSkip parts them: the T - 1 longest lists are
  only probed, the others, the short ones, are merged.
* The order that tells long lists from short ones: shingles that are frequent
  (counted in every partition, summed over all) come last, the most frequent
  at the end; all others in order of their hash, which costs no count. Any
  order gives whole results; this one keeps merged lists short.
* Short lists lie spread over machines as rows (shingle, id); one shuffle brings
  each together. A pair of a list within the length and the positional bound is
  kept if it meets in as many short lists as a link needs (T less the long
  lists, and more where both sets' short lists say so). Of the two sets one ends
  its short lists first; up to there the merged count is the exact overlap, so
  that set's long lists alone are probed, by binary search for the survivor's
  entry, and the two numbers together are the overlap.
* Lists of up to LONG members make all their pairs. In longer ones each star
  round pairs the members with one centre; found links join members to
  components, and only pairs between components are left. When these are few, or
  a round no longer lessens them, a long list that is still open makes its pairs
  if they take no more room than its members' sets. The others become cells: the
  sets of a list's members, dealt into blocks, go to one task for each pair of
  blocks, which runs the whole T-occurrence search there and gives back links
  alone. So rows grow with the lists' entries (times the blocks of a list), never
  with their pairs. Lists of the same members are one cell.
* That finds the components, not all links. As both ends of a link are in one
  component, the links of each id are then counted there, block by block, by the
  same search. No pair is listed; the work on a component grows with the square
  of its distinct texts.

In a task the lists are arrays: a few entries are merged by a heap, more are
counted, which gives the same numbers; a long list is probed for each survivor
where that is less than reading it.

Words are compared by 64-bit hashes. Null and empty texts, and texts without
words, have no shingles and link with nothing; texts of fewer than 5 words have
one, the whole sequence. A very long text is one set, held whole. Of equal
distances between lists the smaller hash, of equal texts the smaller id goes
first. Rows that share a doc_id are one node with all their texts. Null ids are
nodes of their own. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .wordhash import FOLDED, U, grams, groups

WORDS = 5
#: A link needs NUM / DEN of the union.
NUM, DEN = 75, 100
#: A list is long if its shingle is in more documents, of which COUNTED in one run of rows.
LONG = 8
COUNTED = 2
#: Long lists in the order that is sent to the tasks; the shortest beyond stay in hash order.
ORDERED = 200_000
#: Open pairs of long lists that are not worth a star round.
PAIRS = 50_000
#: A star round that leaves more than this share of the pairs is the last one.
PROGRESS = 0.6
#: Shingles of sets that take as much room as a pair.
PAIR_SHINGLES = 4
#: DivideSkip's weight of a list's length against its number; entries that a heap merges; entries that cost as much as one probe.
WEIGHT = 0.2
HEAP = 24
PROBE = 20
#: Texts, and shingles, of a block of a component or a long list.
BLOCK_TEXTS = 500
BLOCK_SHINGLES = 1 << 20


def shingle_sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every row."""
    for row, _, data, offsets in groups(batch):
        s, e, first = FOLDED.spans(data, offsets)
        h = FOLDED.hashes(data, s, e)
        g = grams(h, WORDS)
        for d in range(len(first) - 1):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= WORDS:
                yield row + d, np.unique(g[a : b - WORDS + 1])
            elif b > a:
                yield row + d, grams(h[a:b], b - a)
            else:
                yield row + d, np.zeros(0, U)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that COUNTED documents or more of a run of rows share."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        many = counts >= COUNTED
        return pa.record_batch({"shingle": _signed(values[many]), "n": pa.array(counts[many])})

    for b in batches:
        for _, found in shingle_sets(b):
            held.append(found)
            size += len(found)
            if size >= 3_000_000:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def prefix(found: np.ndarray, late: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of a sorted set whose lists are merged, the shortest first; late: sorted long ones, with ranks."""
    n = len(found)
    keep = n - -(-NUM * n // DEN) + 1
    if not len(late):
        return found[:keep]
    at = np.minimum(np.searchsorted(late, found), len(late) - 1)
    is_late = late[at] == found
    early = found[~is_late]
    if len(early) >= keep:
        return early[:keep]
    return np.concatenate((early, found[is_late][np.argsort(rank[at[is_late]], kind="stable")][: keep - len(early)]))


def _prefixes(late: np.ndarray, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            out: list[tuple[np.ndarray, int, int]] = []
            size = 0
            for row, found in shingle_sets(b):
                if not len(found):
                    continue
                out.append((prefix(found, late, rank), row, len(found)))
                size += len(out[-1][0])
                if size >= 100_000:
                    yield _rows(out, ids)
                    out, size = [], 0
            if out:
                yield _rows(out, ids)

    return run


def _rows(out: list[tuple[np.ndarray, int, int]], ids: np.ndarray) -> pa.RecordBatch:
    lengths = [len(x) for x, _, _ in out]
    return pa.record_batch({
        "shingle": _signed(np.concatenate([x for x, _, _ in out])),
        "doc_id": pa.array(np.repeat(np.array([ids[r] for _, r, _ in out], np.int64), lengths)),
        "n": pa.array(np.repeat(np.array([n for _, _, n in out], np.int32), lengths)),
        "place": pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])),
    })


_PREFIX = "shingle long, doc_id long, n int, place int"


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch({"doc_id": b.column("doc_id"), "n_shingles": pa.array([len(x) for _, x in shingle_sets(b)], pa.int64())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [x.tobytes() for _, x in shingle_sets(b)]
        yield pa.record_batch({"doc_id": b.column("doc_id"), "shingles": pa.array(found, pa.binary())})


def _parted(late: np.ndarray, rank: np.ndarray):
    """Sets, and of each the shingles of its long lists, and the place in the order at which its short lists end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, long, level, end, n = [], [], [], [], []
            for _, found in shingle_sets(b):
                short = prefix(found, late, rank)
                whole.append(found.tobytes())
                long.append(np.setdiff1d(found, short, assume_unique=True).tobytes())
                at = min(int(np.searchsorted(late, short[-1])), len(late) - 1) if len(late) and len(short) else -1
                level.append(int(rank[at]) if at >= 0 and late[at] == short[-1] else 0)
                end.append(int(short[-1]) if len(short) else 0)
                n.append(len(found))
            # the order of unsigned hashes as one of signed numbers
            ends = pa.array((np.array(end, U) ^ U(1 << 63)).view(np.int64))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n": pa.array(n, pa.int64()), "shingles": pa.array(whole, pa.binary()), "long": pa.array(long, pa.binary()), "level": pa.array(level, pa.int64()), "end": ends})

    return run


_PARTED = "doc_id long, n long, shingles binary, long binary, level long, end long"


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs that reach the required overlap: what their short lists have in common, and what probes of a's long lists find of b."""
    for b in batches:
        keep = []
        for both, n, long, other in zip(b.column("both").to_pylist(), b.column("n").to_pylist(), b.column("long"), b.column("shingles"), strict=True):
            long, other = np.frombuffer(long.as_buffer(), U), np.frombuffer(other.as_buffer(), U)
            size = n + len(other)
            if (NUM + DEN) * (both + len(long)) >= NUM * size:
                both += int((other[np.minimum(np.searchsorted(other, long), len(other) - 1)] == long).sum())
            keep.append((NUM + DEN) * both >= NUM * size)
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class Lists:
    """Inverted lists over some sets: each list has the sets' numbers in ascending order."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(x) for x in sets], np.int64)
        self.shingles, code = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.entries = np.repeat(np.arange(len(sets)), self.n)[order]
        self.start = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(self.shingles)))))
        self.keys = code[order] * len(sets) + self.entries  # ascending: what a probe searches

    def reaching(self, query: np.ndarray, beyond: int = -1) -> np.ndarray:
        """Numbers greater than ``beyond`` of the sets that link with the query, by DivideSkip."""
        none, size = np.zeros(0, np.int64), len(query)
        least = -(-NUM * size // DEN)
        at = np.minimum(np.searchsorted(self.shingles, query), len(self.shingles) - 1)
        at = at[self.shingles[at] == query]
        length = self.start[at + 1] - self.start[at]
        if beyond >= 0:
            at, length = at[length > 1], length[length > 1]
        if len(at) < least:
            return none
        order = np.argsort(length, kind="stable")
        at, length = at[order], length[order]
        longs = min(least - 1, int(least / (WEIGHT * np.log2(max(2, length[-1])) + 1)))
        met = self._merged(at[: len(at) - longs], length[: len(at) - longs])
        rest, rest_length = at[len(at) - longs :], length[len(at) - longs :]
        fits = lambda x, more: (DEN * np.minimum(self.n[x], size) >= NUM * np.maximum(self.n[x], size)) & ((NUM + DEN) * (met[x] + more) >= NUM * (self.n[x] + size))
        left = np.flatnonzero(met >= least - longs)
        left = left[(left > beyond) & fits(left, longs)]
        if longs and len(left):
            if len(left) * longs * PROBE <= int(rest_length.sum()):
                probes = (rest[:, None] * len(self.n) + left).ravel()
                hit = self.keys[np.minimum(np.searchsorted(self.keys, probes), len(self.keys) - 1)] == probes
                met[left] += hit.reshape(longs, -1).sum(0)
            else:
                met = met + self._merged(rest, rest_length)
        return left[fits(left, 0)]

    def _merged(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """In how many of some lists each set is."""
        runs = [self.entries[a:b] for a, b in zip(self.start[at].tolist(), self.start[at + 1].tolist())]
        if int(length.sum()) > HEAP:
            return np.bincount(np.concatenate(runs), minlength=len(self.n))
        met = np.zeros(len(self.n), np.int64)
        for number, same in groupby(heapq.merge(*(r.tolist() for r in runs))):
            met[number] = len(list(same))
        return met


def linked(left: list[np.ndarray], right: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of all linked pairs of left and right, or of left alone."""
    if not left or right == []:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lists = Lists(left if right is None else right)
    found = [lists.reaching(x, i if right is None else -1) for i, x in enumerate(left)]
    return np.repeat(np.arange(len(left)), [len(x) for x in found]), np.concatenate(found)


def _forest(a: list[int], b: list[int]) -> list[int]:
    """Places of links (a, b) that join what those before them leave apart."""
    over: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := over.get(x, x)) != x:
            over[x] = x = over.get(y, y)
        return x

    out = []
    for i, (x, y) in enumerate(zip(map(top, a), b)):
        x, y = top(x), top(y)
        if x != y:
            over[x] = y
            out.append(i)
    return out


def _open_cell(rows: pa.Table) -> pa.RecordBatch:
    """a, b: links between the components of a cell's queries (asks) and its other members, as few as join them."""
    ids, part = rows.column("doc_id").to_numpy(), rows.column("c").to_numpy()
    asks = rows.column("asks").to_numpy(zero_copy_only=False)
    sets = [np.frombuffer(x.as_buffer(), U) for x in rows.column("shingles")]
    x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(x) or not len(y):
        return pa.record_batch({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    a, b = linked([sets[i] for i in x], [sets[i] for i in y])
    a, b = x[a], y[b]
    some = np.array(_forest(part[a].tolist(), part[b].tolist()), np.int64)
    return pa.record_batch({"a": pa.array(ids[a[some]]), "b": pa.array(ids[b[some]])})


def _cell(rows: pa.Table) -> pa.RecordBatch:
    """unit, n: the ids that each unit links to within a pair of blocks, from rows unit, weight, other, shingles."""
    unit, weight, other = (rows.column(x).to_numpy() for x in ("unit", "weight", "other"))
    sets = [np.frombuffer(x.as_buffer(), U) for x in rows.column("shingles")]
    x, y = np.flatnonzero(~other), np.flatnonzero(other)
    if rows.column("i")[0] == rows.column("j")[0]:
        y = x
        a, b = linked([sets[k] for k in x], None)
    else:
        a, b = linked([sets[k] for k in x], [sets[k] for k in y]) if len(x) and len(y) else (x[:0], y[:0])
    a, b = x[a], y[b]
    swap = unit[a] > unit[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    _, once = np.unique(np.stack([unit[a], unit[b]]), axis=1, return_index=True)  # units of several texts
    a, b = a[once], b[once]
    apart = unit[a] != unit[b]
    a, b = a[apart], b[apart]
    units, at = np.unique(np.concatenate((unit[a], unit[b])), return_inverse=True)
    n = np.zeros(len(units), np.int64)
    np.add.at(n, at, np.concatenate((weight[b], weight[a])))
    return pa.record_batch({"unit": pa.array(units), "n": pa.array(n)})  # a row for each unit, not for each pair


def _by_cell(keys: list[str], cell):
    """cell(rows) of every cell; the rows of a cell, which have equal keys, are together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            found = np.stack([b.column(x).to_numpy() for x in keys], 1)
            cut = [0, *(np.flatnonzero((found[1:] != found[:-1]).any(1)) + 1).tolist(), len(found)]
            for start, stop in zip(cut, cut[1:]):
                if start == stop:
                    continue
                if held and now != tuple(found[start]):
                    yield cell(pa.Table.from_batches(held))
                    held = []
                now = tuple(found[start])
                held.append(b.slice(start, stop - start))
        if held:
            yield cell(pa.Table.from_batches(held))

    return run


def _overlap() -> Column:
    """The shingles that two sets of an and bn must have in common to link."""
    return F.ceil((F.col("an") + F.col("bn")) * NUM / (NUM + DEN))


def _could_link() -> Column:
    """The length bound, and the positional bound, which holds at the first shingle in common: enough must be left behind it."""
    return (F.col("ac") != F.col("bc")) & (DEN * F.least("an", "bn") >= NUM * F.greatest("an", "bn")) & (F.least(F.col("an") - F.col("ap"), F.col("bn") - F.col("bp")) >= _overlap())


def _reaching(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, an, b, bn), once each, that are together in as many short lists as a link needs, and in how many.

    A link of sets with the required overlap T leaves at most an - T shingles
    of a out of b. Of the two prefixes one ends first in the order; its
    shingles that are in the other set are in the other prefix, too. own: the
    short lists of each document that have another member.
    """
    x, y = (own.select(F.col("doc_id").alias(c), F.col("lists").alias(f"{c}_lists")) for c in ("a", "b"))
    listed = lambda n: F.col(n) - F.ceil(F.col(n) * NUM / DEN) + 1
    least = F.least(listed("an") - F.col("an"), listed("bn") - F.col("bn")) + _overlap()
    both = pairs.select("a", "an", "b", "bn").distinct().join(x, "a").join(y, "b")
    both = both.withColumn("both", F.size(F.array_intersect("a_lists", "b_lists"))).filter(F.col("both") >= least)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "both").distinct()


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that link; a becomes the one whose short lists end first."""
    ends = lambda c: sets.select(F.col("doc_id").alias(c), F.struct("level", "end").alias(f"{c}_end"))
    first = F.col("a_end") <= F.col("b_end")
    turned = pairs.join(ends("a"), "a").join(ends("b"), "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("b"), "both").distinct()
    return turned.join(sets.select(F.col("doc_id").alias("a"), "n", "long"), "a").join(sets.select(F.col("doc_id").alias("b"), "shingles"), "b").mapInArrow(_probe, "a long, b long")


def _side(x: str) -> list[Column]:
    return [F.col("doc_id").alias(x), F.col("n").alias(f"{x}n"), F.col("place").alias(f"{x}p"), F.col("c").alias(f"{x}c")]


def _search(docs: DataFrame, scratch: common.Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Enough links (a, b) between distinct texts to have the components of all links, and the components themselves."""
    spark = docs.sparkSession
    late = docs.mapInArrow(_frequent, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") > LONG)
    top = common.most_frequent(scratch.write(late, f"{name}_late"), "n", ORDERED).toArrow()
    values, counts = top.column("shingle").to_numpy().view(U), top.column("n").to_numpy()
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    listed = scratch.write(docs.mapInArrow(_prefixes(values, counts), _PREFIX), f"{name}_listed")
    shared = scratch.write(listed.groupBy("shingle").agg(F.count("*").alias("size")).filter("size > 1"), f"{name}_shared")  # its shuffle files go before those of the join
    lists = scratch.write(listed.join(shared, "shingle"), f"{name}_lists")
    own = scratch.write(lists.groupBy("doc_id").agg(F.collect_list("shingle").alias("lists")), f"{name}_own")
    scratch.drop(f"{name}_listed", f"{name}_late", f"{name}_shared")
    links, found, round_, before = None, None, 0, None
    small, now = lists.filter(F.col("size") <= LONG).withColumn("c", F.col("doc_id")), lists.filter(F.col("size") > LONG).withColumn("c", F.col("doc_id"))
    while True:
        at = lambda x: f"{name}_{x}{round_}"  # noqa: B023, E731
        by = now.groupBy("shingle", "c").agg(F.count("*").alias("k"), F.sum("n").alias("of_c")).groupBy("shingle")
        by = by.agg(((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("pairs"), F.sum("of_c").alias("shingles"), F.max_by("c", F.struct("k", "c")).alias("main"))
        open_lists = scratch.write(by.filter("pairs > 0"), at("open"))
        left = open_lists.agg(F.sum("pairs")).first()[0] or 0
        if round_ and not left:
            break
        last = left <= PAIRS or (before is not None and left > PROGRESS * before)
        before = left
        still = scratch.write(now.join(open_lists.select("shingle", "main", (F.col("pairs") * PAIR_SHINGLES <= F.col("shingles")).alias("few")), "shingle"), at("still"))
        pairs = None
        if left:
            if round_:
                turn, ranked = F.xxhash64(F.lit(round_), "doc_id"), still
            else:  # the member that meets most others, as the original of edited copies does
                met = still.groupBy("doc_id").agg(F.sum("size").alias("met")).withColumnRenamed("doc_id", "member")
                turn, ranked = -F.col("met"), still.join(met, F.col("doc_id") == F.col("member"))
            if last and round_:
                pairs = _all_pairs(still.filter("few"))
            else:
                centre = ranked.groupBy("shingle").agg(F.min(F.struct(turn.alias("t"), *_side("b"))).alias("m")).select("shingle", "m.*").drop("t")
                pairs = still.select(F.col("shingle").alias("list"), *_side("a")).join(scratch.write(centre, at("centre")), (F.col("list") == F.col("shingle")) & _could_link())
        if not round_:  # lists of a few members
            pairs = _all_pairs(small) if pairs is None else _all_pairs(small).unionByName(pairs)
        pairs = scratch.write(_reaching(pairs, own), at("pairs"))
        scratch.drop(at("now"), at("open"), at("centre"))
        members = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        members = scratch.write(members, at("members"))
        sets = scratch.write(common.within(docs, members, members.count()).mapInArrow(_parted(values, counts), _PARTED), at("sets"))
        new = scratch.write(_links(pairs, sets), at("links"))
        scratch.drop(at("sets"), at("pairs"))
        links = new if links is None else links.unionByName(new)
        if last and round_:
            rest = still.filter("not few")
            if not rest.isEmpty():
                links = links.unionByName(_cells(docs, rest, scratch, at))
        found = scratch.write(components(links, scratch, at("components")), at("found"))
        if not left or (last and round_):
            break
        round_ += 1
        now = still.drop("c", "main", "few").join(found.select(F.col("node").alias("member"), "component"), F.col("doc_id") == F.col("member"), "left")
        now = scratch.write(now.select("shingle", "doc_id", "n", "place", "size", F.coalesce("component", "doc_id").alias("c")), at("now"))
    scratch.drop(f"{name}_lists")
    return links, found


def _all_pairs(lists: DataFrame) -> DataFrame:
    """The pairs of different components of some lists, within the length and the positional bound."""
    return lists.select(F.col("shingle").alias("list"), *_side("a")).join(lists.select("shingle", *_side("b")), (F.col("list") == F.col("shingle")) & (F.col("a") < F.col("b")) & _could_link())


def _cells(docs: DataFrame, still: DataFrame, scratch: common.Scratch, at) -> DataFrame:
    """Links (a, b) that join what the open lists' members can still join: of each list the members outside its
    largest component ask all its members."""
    spark = docs.sparkSession
    alike = still.groupBy("shingle").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("y"))
    once = alike.groupBy("k", "x", "y").agg(F.min("shingle").alias("shingle")).select("shingle")
    mine = scratch.write(still.join(once, "shingle").select("shingle", "doc_id", "c", "main", "n"), at("asked"))
    members = scratch.write(mine.select("doc_id").distinct(), at("asking"))
    sets = scratch.write(common.within(docs, members, members.count()).mapInArrow(_sets, "doc_id long, shingles binary"), at("asked_sets"))
    asks = F.col("c") != F.col("main")
    blocks = lambda which: F.greatest(F.lit(1), F.ceil(F.greatest(F.count(F.when(which, 1)) / BLOCK_TEXTS, F.sum(F.when(which, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)))
    large = scratch.write(mine.groupBy("shingle").agg(blocks(asks).alias("rows"), blocks(F.lit(True)).alias("columns")).filter("columns > 1"), at("large"))
    n = large.count()
    dealt = mine.join(F.broadcast(large) if n <= common.BROADCAST_ROWS else large, "shingle", "left").fillna(1, ["rows", "columns"])
    place = lambda k: F.pmod(F.xxhash64("doc_id"), F.col(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    asked = dealt.select("shingle", place("columns").alias("j"), every("rows").alias("i"), "doc_id", "c", F.lit(False).alias("asks"))
    asking = dealt.filter(asks).select("shingle", every("columns").alias("j"), place("rows").alias("i"), "doc_id", "c", F.lit(True).alias("asks"))
    cells = asked.unionByName(asking).join(sets, "doc_id").repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    out = scratch.write(cells.mapInArrow(_by_cell(["shingle", "i", "j"], _open_cell), "a long, b long"), at("cells"))
    scratch.drop(at("asked"), at("asking"), at("asked_sets"), at("large"))
    return out


def _all_components(docs: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """node, component of every id that is in a group of two or more, and the keys of all rows; docs: as texts() has them."""
    keys, copies, n_copies = common.exact_copies(docs, scratch)
    texts = keys.filter("has_word and doc_id is not null")
    several = scratch.write(texts.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("digest").alias("x"), F.max("digest").alias("y")).filter("n > 1").select("doc_id", (F.col("x") != F.col("y")).alias("more")), "several")
    n_several = several.count()
    if n_several:
        return _of_several(docs, texts, several, n_several, scratch), keys
    _, found = _search(common.without(docs.filter("doc_id is not null"), copies.select("doc_id"), n_copies), scratch, "near")
    if not n_copies:
        return found, keys
    twins = copies.select("doc_id", "rep").distinct().join(found, F.col("rep") == F.col("node"), "left")
    with_twins = F.coalesce("component", "rep")
    reps = copies.select(F.col("rep").alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return scratch.write(found.unionByName(reps).unionByName(twins.select(F.col("doc_id").alias("node"), with_twins.alias("component"))), "grouped"), keys


def _of_several(docs: DataFrame, texts: DataFrame, several: DataFrame, n_several: int, scratch: common.Scratch) -> DataFrame:
    """node, component where ids have several rows: the search is over texts, each once; the ids of a text, as the texts (more) of an id, are linked."""
    marked = texts.distinct().join(F.broadcast(several) if n_several <= common.BROADCAST_ROWS else several, "doc_id", "left")
    own = F.xxhash64(F.lit("text"), "digest")  # stands for a text whose smallest id has others, too
    nodes = marked.groupBy("digest").agg(F.min_by(F.struct("doc_id", "more"), "doc_id").alias("first"))
    nodes = scratch.write(nodes.select("digest", F.col("first.doc_id").alias("rep"), F.when(F.coalesce("first.more", F.lit(False)), own).otherwise(F.col("first.doc_id")).alias("as_node")), "text_nodes")
    keyed = docs.filter("doc_id is not null").withColumn("digest", F.sha2("text", 256)).join(nodes, "digest").filter("doc_id = rep")
    once = keyed.groupBy("as_node").agg(F.first("text").alias("text")).withColumnRenamed("as_node", "doc_id")
    links, _ = _search(scratch.write(once, "once"), scratch, "near")
    ties = scratch.write(texts.distinct().join(nodes, "digest").select(F.col("doc_id").alias("a"), F.col("as_node").alias("b")), "ties")
    found = components(links.unionByName(ties), scratch, "joined")
    real = texts.select(F.col("doc_id").alias("node")).distinct().join(found, "node")
    least = real.groupBy("component").agg(F.min("node").alias("least"))
    return scratch.write(real.join(least, "component").select("node", F.col("least").alias("component")), "grouped")


def _link_counts(docs: DataFrame, found: DataFrame, keys: DataFrame, scratch: common.Scratch) -> DataFrame:
    """node, component, n_links of every id in found: with how many other ids it has a linked or an equal text."""
    mine = keys.filter("has_word and doc_id is not null").join(found, F.col("doc_id") == F.col("node"))
    nodes = mine.groupBy("node", "component").agg(F.sha2(F.concat_ws(" ", F.array_sort(F.collect_set("digest"))), 256).alias("kind"))
    nodes = scratch.write(nodes, "nodes")
    kinds = scratch.write(nodes.groupBy("component", "kind").agg(F.min("node").alias("unit"), F.count("*").alias("weight")), "kinds")
    several = kinds.groupBy("component").agg(F.count("*").alias("c")).filter("c > 1").select("component")
    units = scratch.write(kinds.join(several, "component", "left_semi").select("component", "unit", "weight"), "units")
    sets = common.within(docs, units.select(F.col("unit").alias("doc_id")), units.count()).mapInArrow(_sets, "doc_id long, shingles binary").filter(F.length("shingles") > 0).dropDuplicates()
    members = scratch.write(sets.withColumnRenamed("doc_id", "unit").join(units, "unit"), "unit_sets")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_TEXTS, F.sum(F.length("shingles")) / (8 * BLOCK_SHINGLES)))
    large = scratch.write(members.groupBy("component").agg(blocks.alias("blocks")).filter("blocks > 1"), "blocks")  # few: each has a block's worth of members
    dealt = members.join(F.broadcast(large), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("unit"), "blocks")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cells = dealt.select("component", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") > F.col("with")).alias("other"), "unit", "weight", "shingles")
    cells = cells.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    linked_to = scratch.write(cells.mapInArrow(_by_cell(["component", "i", "j"], _cell), "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n")), "linked")
    scratch.drop("unit_sets", "units")
    counts = scratch.write(kinds.join(linked_to, "unit", "left").select("component", "kind", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "kind_links")
    return scratch.write(nodes.join(counts, ["component", "kind"]).select("node", "component", "n_links"), "node_links")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    common.ship(docs.sparkSession)
    docs = common.texts(docs)
    found, _ = _all_components(docs, common.Scratch(docs.sparkSession, "jaccard"))
    sizes = docs.mapInArrow(_sizes, "doc_id long, n_shingles long")
    return sizes.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def linked_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row of docs (doc_id, text); n_links: the other ids that it links with."""
    common.ship(docs.sparkSession)
    docs = common.texts(docs)
    scratch = common.Scratch(docs.sparkSession, "jaccard")
    counts = _link_counts(docs, *_all_components(docs, scratch), scratch)
    sizes = docs.mapInArrow(_sizes, "doc_id long, n_shingles long")
    return sizes.join(counts.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group: that of its smallest id, once if it is repeated; a null id has no near copies, but goes if its text has an id. With the columns of docs."""
    common.ship(docs.sparkSession)
    scratch = common.Scratch(docs.sparkSession, "jaccard")
    found, keys = _all_components(common.texts(docs), scratch)
    gone = scratch.write(found.filter("node != component").select(F.col("node").alias("_gone")), "gone")
    n = gone.count()
    again = keys.filter("has_word").groupBy("digest").agg(F.min("doc_id").alias("_rep"), F.count("*").alias("_n")).filter("_n > 1").select(F.col("digest").alias("_same"), "_rep")
    again = scratch.write(again, "again")
    n_again = again.count()
    mine = common.carried(docs)
    id_, text = mine["_row"].getField("doc_id").cast("long"), F.coalesce(mine["_row"].getField("text").cast("string"), F.lit(""))
    kept = mine.join(F.broadcast(gone) if n <= common.BROADCAST_ROWS else gone, id_ == gone["_gone"], "left_anti")
    if n_again:
        kept = kept.withColumn("_digest", F.sha2(text, 256))
        kept = kept.join(F.broadcast(again) if n_again <= common.BROADCAST_ROWS // 4 else again, F.col("_digest") == F.col("_same"), "left")
        kept = kept.filter(F.col("_same").isNull() | id_.eqNullSafe(F.col("_rep")))
        first = kept.filter("_same is not null").groupBy("_same").agg(F.first("_row").alias("_row"))
        kept = kept.filter("_same is null").select("_row").unionByName(first.select("_row"))
    return common.unpacked(kept, docs.columns)


#: DuckDB SQL for the columns of linked_copies().
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, gram FROM (
  SELECT doc_id, array_to_string(ws[i : i + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a, min(b) AS least FROM r GROUP BY a),
c AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id, CAST(coalesce(links, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.a = w.doc_id LEFT JOIN c ON c.a = w.doc_id
"""
