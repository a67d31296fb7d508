"""Benchmark decontamination: a prefix-filtered join of documents with item windows.

The tokens of a window are its shingles of SHINGLE words (all its words, if it
has fewer), ordered by how rare they are in all documents. A window must be
contained whole, so its one rarest shingle is a necessary prefix: documents are
joined on these shingles alone. A hit gives, by the shingle's offsets in windows
(the positional bound) and the windows' lengths, the few places where a window
could lie inside the document; there the hash of the whole window is looked up
among those of the items, once for a place, however many windows share the
shingle, and at last its words are compared, byte by byte.

Items of up to ``block_bytes`` of text are sent to the tasks, after their size
is summed. Beyond that nothing but two bit maps of at most ``bits`` bits goes
there: shingles are counted, and windows are joined, by shuffles, and the maps
only keep most of what cannot match out of them. Both ways read the documents
twice, however large the benchmark is.

Null and empty texts and items have no words. An item without an id has windows
like others, and is not among the ids. Repeated items count once; repeated
documents get a row each. Of equally rare shingles the one of the smaller hash
comes first. Very long texts are read whole. An empty table of documents gives
no rows, an empty benchmark no hits. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import ALNUM, U, _STEP, grams, groups, mix

#: Bytes of item text that are sent to every task, at most.
BLOCK_BYTES = 1 << 20
#: Words of a shingle.
SHINGLE = 5
#: Bits of a map of shingles, at most (a power of two).
BITS = 1 << 28
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _windows(text: bytes, window: int) -> Iterator[tuple[bytes, int, int, np.ndarray]]:
    """(folded words with a blank between, length, hash, shingles) of the distinct windows of an item."""
    data = np.frombuffer(text, np.uint8)
    s, e, _ = ALNUM.spans(data, np.array([0, len(data)]))
    h = ALNUM.hashes(data, s, e)
    words = [text[a:b].translate(_FOLD) for a, b in zip(s, e, strict=True)]
    n = min(window, len(words))
    if not n:
        return
    whole, parts, seen = grams(h, n), grams(h, min(SHINGLE, n)), set()
    for i in range(len(words) - n + 1):
        key = b" ".join(words[i : i + n])
        if key not in seen:
            seen.add(key)
            yield key, n, int(whole[i]), parts[i : i + n - min(SHINGLE, n) + 1]


class Index:
    """The windows of some items [(item_id, text)], found by their hash, and the shingles that lead to them."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        names: dict[tuple[int, int, bytes], set[str]] = defaultdict(set)
        shingles: dict[tuple[int, int, bytes], np.ndarray] = {}
        for name, text in items:
            for key, n, gram, parts in _windows(text, window):
                names[gram, n, key] |= {name} - {None}
                shingles[gram, n, key] = parts
        self.keys = sorted(names)
        self.names = [sorted(names[k]) for k in self.keys]
        self.gram, self.length = np.array([k[0] for k in self.keys], U), np.array([k[1] for k in self.keys], np.int64)
        self.shingles = [shingles[k] for k in self.keys]
        self.sizes = sorted({int(min(SHINGLE, n)) for n in self.length})
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, U), *self.shingles]))

    def join_on(self, counts: np.ndarray) -> None:
        """Picks each window's rarest shingle; counts: by shingle of the vocabulary."""
        rows = set()
        for n, parts in zip(self.length.tolist(), self.shingles, strict=True):
            at = int(np.lexsort((parts, counts[np.searchsorted(self.vocabulary, parts)]))[0])
            rows.add((int(parts[at]), n, at))
        found = sorted(rows)
        self.token = np.array([r[0] for r in found], U)
        self.token_length, self.token_offset = (np.array([r[i] for r in found], np.int64) for i in (1, 2))
        del self.shingles, self.vocabulary


def _count(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = index.vocabulary
        total = np.zeros(len(vocabulary), np.int64)
        for b in batches:
            for _, _, data, offsets in groups(b):
                s, e, _ = ALNUM.spans(data, offsets)
                h = ALNUM.hashes(data, s, e)
                for k in index.sizes:  # shingles over two texts only change a count, never a match
                    g = grams(h, k)
                    at = np.minimum(np.searchsorted(vocabulary, g), len(vocabulary) - 1)
                    total += np.bincount(at[vocabulary[at] == g], minlength=len(vocabulary))
        some = np.flatnonzero(total)
        yield pa.record_batch({"word": pa.array(some), "n": pa.array(total[some])})

    return run


def _grams_at(h: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(len(start), U)
    for j in range(size):
        total = total * _STEP + h[start + j]
    return mix(total + U(size))


def _matches(index: Index, data: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int]]:
    """(start word, length, window) of every true occurrence in a group of texts."""
    h, found = ALNUM.hashes(data, s, e), []
    for size in np.unique(index.token_length).tolist():
        mine = index.token_length == size
        token, offset = index.token[mine], index.token_offset[mine]
        g = grams(h, min(SHINGLE, size))
        lo, hi = np.searchsorted(token, g, "left"), np.searchsorted(token, g, "right")
        at = np.flatnonzero(hi > lo)
        starts = [at[hi[at] - lo[at] > j] - offset[lo[at[hi[at] - lo[at] > j]] + j] for j in range(int((hi - lo).max(initial=0)))]  # a shingle has few offsets
        start = np.unique(np.concatenate([np.zeros(0, np.int64), *starts]))
        start = start[start >= 0]
        doc = np.searchsorted(first, start, "right") - 1
        start = start[start + size <= first[doc + 1]]
        gram = _grams_at(h, start, size)
        lo, hi = np.searchsorted(index.gram, gram, "left"), np.searchsorted(index.gram, gram, "right")
        for i in np.flatnonzero(hi > lo).tolist():
            a = int(start[i])
            words = b" ".join(data[x:y].tobytes().translate(_FOLD) for x, y in zip(s[a : a + size], e[a : a + size], strict=True))
            found += [(a, size, k) for k in range(int(lo[i]), int(hi[i])) if index.keys[k][1:] == (size, words)]
    return found


_DDL = "doc_id long, digest string, n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def _scan(index: Index):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, spans, items = [], [], []
            for _, _, data, offsets in groups(b):
                s, e, first = ALNUM.spans(data, offsets)
                hits = defaultdict(list)
                for a, size, key in _matches(index, data, s, e, first):
                    hits[int(np.searchsorted(first, a, "right")) - 1].append((a, size, key))
                for d in range(len(first) - 1):
                    base = int(first[d])
                    n_words.append(int(first[d + 1]) - base)
                    spans.append([{"start": x, "end": y} for x, y in merged([(a - base, a - base + size) for a, size, _ in hits.get(d, ())])])
                    items.append(sorted({name for _, _, key in hits.get(d, ()) for name in index.names[key]}))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "digest": b.column("digest"), "n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, span), "items": pa.array(items, pa.list_(pa.string()))})

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


# ---- a benchmark of more than one block


def _exploded(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                rows = list(_windows(text, window))
                if rows:
                    yield pa.record_batch({
                        "item_id": pa.array([name] * len(rows), pa.string()), "key": pa.array([r[0] for r in rows], pa.binary()), "length": pa.array([r[1] for r in rows], pa.int64()),
                        "gram": pa.array(np.array([r[2] for r in rows], U).view(np.int64)), "shingles": pa.array([r[3].view(np.int64).tolist() for r in rows], pa.list_(pa.int64())),
                    })

    return run


def _map(shingles: DataFrame, bits: int) -> np.ndarray:
    """A bit for each shingle: by the lowest bits of its hash. The driver gets bits / 64 rows at most."""
    place = F.col("shingle").bitwiseAND(F.lit(bits - 1))
    words = shingles.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy()
    return out.view(U)


def _on(map_: np.ndarray, g: np.ndarray) -> np.ndarray:
    place = g & U(len(map_) * 64 - 1)
    return (map_[place >> U(6)] >> (place & U(63))) & U(1) == 1


def _counts(map_: np.ndarray, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in groups(b):
                s, e, _ = ALNUM.spans(data, offsets)
                h = ALNUM.hashes(data, s, e)
                g = np.concatenate([grams(h, k) for k in sizes])
                values, n = np.unique(g[_on(map_, g)], return_counts=True)
                yield pa.record_batch({"shingle": pa.array(values.view(np.int64)), "n": pa.array(n)})

    return run


def _candidates(map_: np.ndarray, lengths: list[int]):
    """The documents' windows over a shingle of the map, with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, digests = b.column("doc_id").to_pylist(), b.column("digest").to_pylist()
            for row, _, data, offsets in groups(b):
                s, e, first = ALNUM.spans(data, offsets)
                h = ALNUM.hashes(data, s, e)
                for size in lengths:
                    k = min(SHINGLE, size)
                    hit = np.concatenate(([0], np.cumsum(_on(map_, grams(h, k)))))
                    start = np.arange(max(0, len(h) - size + 1))
                    start = start[hit[start + size - k + 1] > hit[start]]
                    doc = np.searchsorted(first, start, "right") - 1
                    ok = start + size <= first[doc + 1]
                    start, doc = start[ok], doc[ok]
                    gram = _grams_at(h, start, size)
                    for i in range(0, len(start), 4096):
                        at, own = start[i : i + 4096], doc[i : i + 4096]
                        yield pa.record_batch({
                            "doc_id": pa.array([ids[row + d] for d in own], pa.int64()), "digest": pa.array([digests[row + d] for d in own], pa.string()),
                            "start": pa.array(at - first[own]), "length": pa.array(np.full(len(at), size)), "gram": pa.array(gram[i : i + 4096].view(np.int64)),
                            "words": pa.array([b" ".join(data[x:y].tobytes().translate(_FOLD) for x, y in zip(s[a : a + size], e[a : a + size], strict=True)) for a in at.tolist()], pa.binary()),
                        })

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [np.diff(ALNUM.spans(data, offsets)[2]) for _, _, data, offsets in groups(b)]
        yield pa.record_batch({"doc_id": b.column("doc_id"), "digest": b.column("digest"), "n_words": pa.array(np.concatenate([np.zeros(0, np.int64), *n]))})


def _by_shuffles(docs: DataFrame, items: DataFrame, window: int, bits: int, scratch: common.Scratch) -> DataFrame:
    """What _scan gives, for any number of items."""
    every = scratch.write(items.mapInArrow(_exploded(window), "item_id string, key binary, length long, gram long, shingles array<long>"), "windows")
    once = scratch.write(every.groupBy("gram", "length", "key").agg(F.min("shingles").alias("shingles")), "once")
    lengths = sorted(r.length for r in once.select("length").distinct().collect())  # window at most
    docs_of = docs.select("doc_id", "digest", "text")
    if not lengths:
        index = Index([], window)
        index.join_on(np.zeros(0, np.int64))
        return docs_of.mapInArrow(_scan(index), _DDL)
    shingles = scratch.write(once.select("gram", "length", "key", F.explode("shingles").alias("shingle")), "shingles")
    sizes = sorted({min(SHINGLE, n) for n in lengths})
    seen = docs_of.mapInArrow(_counts(_map(shingles, bits), sizes), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counted = shingles.join(seen, "shingle", "left").groupBy("gram", "length", "key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle")).alias("least"))
    prefixes = scratch.write(counted.select(F.col("least.shingle").alias("shingle")).distinct(), "prefixes")
    found = docs_of.mapInArrow(_candidates(_map(prefixes, bits), lengths), "doc_id long, digest string, start long, length long, gram long, words binary")
    met = found.join(once.select("gram", "length", "key"), ["gram", "length"]).filter("words = key").select("doc_id", "digest", "start", "length", "gram", "key").distinct()
    met = scratch.write(met, "met")
    spans = met.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
    names = every.filter("item_id is not null").select("gram", "length", "key", "item_id").distinct()
    names = met.select("doc_id", "digest", "gram", "length", "key").distinct().join(names, ["gram", "length", "key"]).groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    own = lambda df, x: df.select(*(F.col(c).alias(f"{x}_{c}" if c in ("doc_id", "digest") else c) for c in df.columns))
    same = lambda x: F.col("doc_id").eqNullSafe(F.col(f"{x}_doc_id")) & (F.col("digest") == F.col(f"{x}_digest"))
    all_ = docs_of.mapInArrow(_words, "doc_id long, digest string, n_words long")
    all_ = all_.join(scratch.write(own(spans, "s"), "spans"), same("s"), "left").join(scratch.write(own(names, "i"), "names"), same("i"), "left")
    none = lambda kind: F.array().cast(kind)
    return all_.select("doc_id", "digest", "n_words", F.coalesce("spans", none("array<struct<start: long, end: long>>")).alias("spans"), F.coalesce("items", none("array<string>")).alias("items"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = BLOCK_BYTES, bits: int = BITS) -> DataFrame:
    """doc_id, digest (of the text), n_words, ascending spans of hit words and ids of found items, of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    common.ship(spark)
    scratch = common.Scratch(spark, "decontamination")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).distinct()
    items = scratch.write(items, "items")
    docs = common.texts(docs).withColumn("digest", F.sha2("text", 256))
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size > block_bytes:
        return _by_shuffles(docs, items, window, min(bits, max(1 << 16, 1 << int(16 * size).bit_length())), scratch)
    index = Index([(r.item_id, bytes(r.text)) for r in items.collect()], window)  # block_bytes at most
    counts = np.zeros(max(1, len(index.vocabulary)), np.int64)
    if len(index.vocabulary):
        for r in docs.mapInArrow(_count(index), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # the vocabulary at most
            counts[r.word] = r.n
    index.join_on(counts)
    return docs.mapInArrow(_scan(index), _DDL)


def _hit(spans: Column) -> Column:
    """Words in the union of ascending spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], x["end"]).alias("end"))
    return F.aggregate(spans, start, step)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row."""
    found = find_leaks(docs, benchmark, window=window, block_bytes=block_bytes)
    n_hit = _hit(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """The rows of docs without any occurrence of an item window, with the columns of docs."""
    spark = docs.sparkSession
    found = common.Scratch(spark, "decontamination").write(find_leaks(docs, benchmark, window=window).filter("size(spans) > 0").select("doc_id", "digest").distinct(), "leaks")
    n = found.count()
    if n == 0:
        return docs
    bad = found.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    mine = common.carried(docs)
    own = F.sha2(F.coalesce(mine["_row"].getField("text").cast("string"), F.lit("")), 256)
    same = (own == bad["_digest"]) & mine["_row"].getField("doc_id").cast("long").eqNullSafe(bad["_id"])
    return common.unpacked(mine.join(F.broadcast(bad) if n <= common.BROADCAST_ROWS // 4 else bad, same, "left_anti"), docs.columns)


#: DuckDB SQL for the columns of decontaminate().
SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM (SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark) WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM t)),
g AS (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS gram FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
h AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM g JOIN win USING (n, gram)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, i + unnest(range(n)) AS p FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, list_sort(list(DISTINCT item_id) FILTER (item_id IS NOT NULL)) AS items FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id
"""
