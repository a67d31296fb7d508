"""Substring deduplication by seed and extend.

A window is ``words`` consecutive words of one document; a word goes if a
window over it has its word sequence also at an earlier place (smaller doc_id,
or the same document and an earlier start).

* Seeds: of the SEED-word grams in each window the one of the smallest hash
  (the leftmost of equals) is the window's anchor, so equal windows have equal
  anchors at equal offsets, and only anchors are shuffled: about two for each
  words - SEED + 2 words.
* Join: anchors that occur once seed nothing and go after a count that is
  combined before the shuffle; documents meet on the others.
* Extend: each place of an anchor is extended to the left and to the right over
  all windows whose anchor it is. Places with the same extension are one match:
  they are joined to the smallest of them, one row for each, and all their
  windows are repeats. The smallest places of an anchor's different extensions,
  which are the ends of matches, are compared window by window.
* The matches of a document that overlap or touch are one maximal repeat of at
  least ``words`` words.

A text that equals, byte for byte, one of a smaller id is a repeat as a whole
and seeds nothing. Words are compared by hashes of 64 bits (an extension and a
window by two).

Null and empty texts have no words. Null ids come before all others. Rows with
equal id and text are one document and get equal results; different texts of
one id, and all texts without one, are ordered by their SHA-256. A very long
text is read whole. Of equal seeds the leftmost is the anchor. An empty table
gives no rows. Extra columns are ignored by ``cut_repeats`` and kept by
``cut_texts``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .wordhash import PLAIN, U, gram_starts, grams, groups, mix

WORDS = 20
#: Words of a seed. Longer seeds repeat less often by chance, shorter ones are picked more sparsely.
SEED = 8
NO_ID = -(2**63)


def anchors(seeds: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` seeds the index of its smallest (leftmost) one."""
    n = len(seeds) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(seeds))
    size = 1

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(seeds[a] <= seeds[b], a, b)

    while 2 * size <= width:
        best = join(best[: len(best) - size], best[size:])
        size *= 2
    return join(best[:n], best[width - size : width - size + n]) if size < width else best[:n]


class _Group:
    """Seeds and anchors of a run of texts: of each anchor the document, its word, and the first and last of its windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: int, seed: int):
        self.start, self.end, self.first = PLAIN.spans(data, offsets)
        self.hash = PLAIN.hashes(data, self.start, self.end)
        self.seeds = grams(self.hash, seed)
        at = anchors(self.seeds, words - seed + 1)
        windows = np.flatnonzero(gram_starts(self.first, words)[: len(at)])  # the first words of windows
        doc = np.searchsorted(self.first, windows, "right") - 1
        new = np.flatnonzero(np.concatenate(([True], (np.diff(at[windows]) != 0) | (np.diff(doc) != 0)))) if len(windows) else windows
        self.doc, self.anchor, self.low = doc[new], at[windows][new], windows[new]
        self.high = windows[np.concatenate((new[1:] - 1, [len(windows) - 1]))] if len(new) else new

    def extensions(self, words: int) -> np.ndarray:
        """A hash of all words in the windows of each anchor, and of the anchor's place in them."""
        powers = _powers(len(self.hash) + 1)
        sums = np.zeros(len(self.hash) + 1, U)
        np.cumsum(self.hash * powers[0][: len(self.hash)], out=sums[1:])
        ends = self.high + words
        inside = (sums[ends] - sums[self.low]) * powers[1][self.low]
        return mix(mix(inside + (ends - self.low).astype(U)) + (self.anchor - self.low).astype(U))


@lru_cache(8)
def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        steps = np.full(size, base, U)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return run(_BASE), run(pow(_BASE, -1, 2**64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2^64: at least n of them."""
    return _power_table(max(1 << 16, 1 << (n - 1).bit_length()))


_BASE = 0x9E3779B97F4A7C15


def _seeds(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, subs = b.column("doc_id").to_numpy(), b.column("sub")
            for row, _, data, offsets in groups(b):
                g = _Group(data, offsets, words, seed)
                if len(g.doc):
                    yield pa.record_batch({
                        "anchor": pa.array(g.seeds[g.anchor].view(np.int64)), "extension": pa.array(g.extensions(words).view(np.int64)),
                        "doc_id": pa.array(ids[row + g.doc]), "sub": subs.take(pa.array(row + g.doc)),
                        "low": pa.array((g.low - g.first[g.doc]).astype(np.int32)), "n": pa.array((g.high - g.low + 1).astype(np.int32)),
                    })

    return run


_SEEDS = "anchor long, extension long, doc_id long, sub binary, low int, n int"


def _ends(words: int, seed: int):
    """The windows of the wanted anchors (lows) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, subs, lows = b.column("doc_id").to_numpy(), b.column("sub"), b.column("lows")
            edge, flat = lows.offsets.to_numpy(), lows.values.to_numpy()
            for row, _, data, offsets in groups(b):
                g = _Group(data, offsets, words, seed)
                wanted = np.zeros(len(g.hash) + 1, np.bool_)
                for d in range(len(g.first) - 1):
                    wanted[g.first[d] + flat[edge[row + d] : edge[row + d + 1]]] = True
                mine = np.flatnonzero(wanted[g.low])
                if len(mine):
                    n = g.high[mine] - g.low[mine] + 1
                    at = np.repeat(g.low[mine] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                    doc = np.repeat(g.doc[mine], n)
                    yield pa.record_batch({
                        "anchor": pa.array(np.repeat(g.seeds[g.anchor[mine]], n).view(np.int64)), "window": pa.array(grams(g.hash, words)[at].view(np.int64)),
                        "doc_id": pa.array(ids[row + doc]), "sub": subs.take(pa.array(row + doc)), "start": pa.array((at - g.first[doc]).astype(np.int32)),
                    })

    return run


def covered(n_words: int, lows: np.ndarray, n: np.ndarray, words: int) -> np.ndarray:
    """True for the words in one of the n windows from each of the lows on."""
    step = np.zeros(n_words + 1, np.int64)
    np.add.at(step, lows, 1)
    np.add.at(step, lows + n - 1 + words, -1)
    return np.cumsum(step[:-1]) > 0


def _cut(words: int):
    """n_words, n_removed, kept_sha256 of each row, or, where rows are carried along, n_words, n_removed and the text that stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            carried = "row" in b.schema.names
            n_words, n_removed, out = [], [], []
            for text, copy, repeats in zip(b.column("text"), b.column("copy").to_pylist(), b.column("repeats"), strict=True):
                text = text.as_py()
                kept = text.split()
                n, gone = len(kept), None
                if copy and n >= words:
                    gone = np.ones(n, np.bool_)
                elif repeats.is_valid and len(repeats):
                    low, many = (repeats.values.field(x).to_numpy() for x in ("low", "n"))
                    gone = covered(n, low, many, words)
                n_words.append(n)
                n_removed.append(0 if gone is None else int(gone.sum()))
                if carried:
                    out.append(None if gone is None else without_words(text, gone))
                else:
                    out.append(hashlib.sha256(b" ".join(kept if gone is None else [kept[i] for i in np.flatnonzero(~gone).tolist()])).hexdigest())
            last = {"row": b.column("row"), "kept": pa.array(out, pa.binary())} if carried else {"doc_id": b.column("doc_id"), "kept_sha256": pa.array(out, pa.string())}
            yield pa.record_batch({"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64())} | last)

    return run


def without_words(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked; the white space before a word goes with it."""
    data = np.frombuffer(text, np.uint8)
    start, end, _ = PLAIN.spans(data, np.array([0, len(data)]))
    before = np.concatenate(([0], end[:-1]))
    keep = np.ones(len(data), np.bool_)
    step = np.zeros(len(data) + 1, np.int64)
    np.add.at(step, before[gone], 1)
    np.add.at(step, end[gone], -1)
    keep = np.cumsum(step[:-1]) == 0
    return data[keep].tobytes().lstrip(b" \t\n\x0b\x0c\r") if gone[:1].any() else data[keep].tobytes()


def _numbered(docs: DataFrame, keys: DataFrame, scratch: common.Scratch) -> DataFrame:
    """docs with sub, which orders the texts of one id: nothing, or, where an id has several and where there is none, half the text's SHA-256."""
    many = keys.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter((F.col("x") != F.col("y")) | (F.col("doc_id") == NO_ID)).select(F.col("doc_id").alias("_many"))
    many = scratch.write(many, "many")
    n = many.count()
    if not n:
        return docs.withColumn("sub", F.lit(b""))
    found = docs.join(F.broadcast(many) if n <= common.BROADCAST_ROWS else many, F.col("doc_id") == F.col("_many"), "left")
    return found.withColumn("sub", F.when(F.col("_many").isNull(), F.lit(b"")).otherwise(F.unhex(F.substring(F.sha2("text", 256), 1, 32)))).drop("_many")


def _repeats(docs: DataFrame, words: int, seed: int, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, sub, copy, and row, if all columns are to be carried along) and, for each doc_id and sub with repeats, runs (low, n) of its repeated windows."""
    spark = docs.sparkSession
    common.ship(spark)
    scratch = common.Scratch(spark, "substrings")
    own = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), *own)
    keys, copies, n_copies = common.exact_copies(docs, scratch)
    docs = _numbered(docs, keys, scratch)
    if n_copies:
        same = copies.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        equal = (F.col("doc_id") == F.col("_id")) & (F.sha2("text", 256) == F.col("_digest"))
        once = docs.join(F.broadcast(same) if n_copies <= common.BROADCAST_ROWS // 4 else same, equal, "left_anti")
    else:
        once = docs
    once = once.select("doc_id", "text", "sub")
    found = scratch.write(once.mapInArrow(_seeds(words, seed), _SEEDS), "found")
    twice = scratch.write(found.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor"), "twice")
    places = scratch.write(found.join(twice, "anchor"), "places")
    scratch.drop("found", "twice")
    place = lambda low: F.struct("doc_id", "sub", low)
    matches = places.groupBy("anchor", "extension").agg(F.min(place(F.col("low").alias("start"))).alias("least"), F.count("*").alias("k"))
    matches = scratch.write(matches, "matches")
    again = places.join(matches.filter("k > 1").select("anchor", "extension", "least"), ["anchor", "extension"]).filter(place(F.col("low").alias("start")) != F.col("least"))
    runs = scratch.write(again.select("doc_id", "sub", "low", "n"), "runs")
    scratch.drop("places")
    several = matches.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1").select("anchor")
    wanted = matches.join(several, "anchor").select("least.*").distinct().groupBy("doc_id", "sub").agg(F.collect_set("start").alias("lows"))
    wanted = scratch.write(wanted, "wanted")
    windows = once.distinct().join(wanted, ["doc_id", "sub"]) if _repeated_rows(keys) else once.join(wanted, ["doc_id", "sub"])
    windows = scratch.write(windows.mapInArrow(_ends(words, seed), "anchor long, window long, doc_id long, sub binary, start int"), "windows")
    least = scratch.write(windows.groupBy("anchor", "window").agg(F.min(place("start")).alias("least"), F.count("*").alias("k")).filter("k > 1").drop("k"), "least")
    ends = windows.join(least, ["anchor", "window"]).filter(place("start") != F.col("least")).select("doc_id", "sub", F.col("start").alias("low"), F.lit(1).alias("n"))
    repeats = scratch.write(runs.unionByName(ends).groupBy("doc_id", "sub").agg(F.collect_set(F.struct("low", "n")).alias("repeats")), "repeats")
    scratch.drop("matches", "runs", "wanted", "windows", "least")
    if n_copies:
        same = copies.select("doc_id", "digest", F.lit(True).alias("copy")).distinct()
        docs = docs.withColumn("digest", F.sha2("text", 256)).join(F.broadcast(same) if n_copies <= common.BROADCAST_ROWS // 4 else same, ["doc_id", "digest"], "left").drop("digest")
    else:
        docs = docs.withColumn("copy", F.lit(False))
    return docs, repeats


def _repeated_rows(keys: DataFrame) -> bool:
    """Whether a row occurs again, with its id and text."""
    return not keys.filter("has_word").groupBy("doc_id", "digest").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def cut_repeats(docs: DataFrame, *, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (doc_id, text)."""
    docs, repeats = _repeats(docs, words, seed)
    ready = docs.join(repeats, ["doc_id", "sub"], "left").select("doc_id", "text", "copy", "repeats")
    out = ready.mapInArrow(_cut(words), "n_words long, n_removed long, doc_id long, kept_sha256 string")
    return out.select(F.nullif("doc_id", F.lit(NO_ID).cast("long")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def cut_texts(docs: DataFrame, *, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """docs, all columns, without the repeated words; a document that had words and has none left goes."""
    columns, kind = docs.columns, docs.schema
    docs, repeats = _repeats(docs, words, seed, carry=True)
    ready = docs.join(repeats, ["doc_id", "sub"], "left").select("text", "copy", "repeats", "row")
    out = ready.mapInArrow(_cut(words), T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("row", kind), T.StructField("kept", T.BinaryType())]))
    out = out.filter("n_words = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("row.text"))
    size = F.when(F.col("n_removed") > 0, F.length(F.col("kept").cast("string")).cast("long"))
    new = {"text": text} | ({"n_chars": F.coalesce(size, F.col("row.n_chars"))} if "n_chars" in columns else {})
    return out.select(*((new[c] if c in new else F.col("row").getField(c)).alias(c) for c in columns))


#: DuckDB SQL for the columns of cut_repeats().
SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, hash(ws[i : i + 19]) AS a, md5(array_to_string(ws[i : i + 19], ' ')) AS b FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b ORDER BY doc_id NULLS FIRST, i) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, list(DISTINCT i + o) AS gone FROM r, (SELECT unnest(range(20)) AS o) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN c ON w.doc_id = c.doc_id
"""
