"""Token counts by overlap resynchronisation.

A document of more than ``chunk_bytes`` is cut into windows that overlap by
``overlap`` bytes on either side of each cut, each encoded with offsets. Two
neighbours are spliced at a byte proven stable, where both encodings have an
edge that what is before it cannot move, and after which both give the same
tokens. A document in which some cut has no such byte is cut again with twice
the overlap, until its windows cover it. Documents of up to ``deal_bytes`` are
cut and spliced in their row's task; the windows of longer ones, of that size,
are dealt out. Documents of up to ``chunk_bytes`` are encoded whole.

Why a byte is stable: where the tokenizer drops white space, words are encoded
one by one, and the byte is the start of a word behind white space. Other files
split a text by a pattern that is matched from left to right and looks ahead
alone. If a split begins at the byte in both windows, all later splits follow
from the text behind it, which both have, and tokens never cross a split; the
earlier ones are the left window's, whose own start was stable. The byte is
ASCII, so that no normalisation joins it to the one before, and more tokens lie
behind it, so that the window's end is out of the pattern's sight. Files whose
pattern is of another kind have no stable bytes and are encoded whole.

Nulls count as empty texts; an empty text has no tokens; a very long text is
read whole, in windows; equal ids, repeated rows and null ids each have their
row; an empty table gives no rows; extra columns are dropped, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .encoder import default_path, encoder

#: Documents of more bytes are cut; of more bytes, dealt out; bytes on either side of a cut; tokens that must agree behind a splice.
CHUNK_BYTES = 1 << 12
DEAL_BYTES = 1 << 16
OVERLAP = 256
AGREE = 4
_SPACE = np.zeros(256, np.bool_)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def encode_with_offsets(text: bytes, enc) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a window, and for each the byte at which its word or split starts; -1 where no edge can be proven."""
    if not enc.by_word:
        whole = text.decode(errors="replace")
        got = enc.tk.encode(whole, add_special_tokens=False)
        lead = np.concatenate(([0], np.cumsum([len(c.encode()) for c in whole], dtype=np.int64)))
        at = lead[np.array([o[0] for o in got.offsets], np.int64)]
        splits = np.array([-1 if w is None else w for w in got.word_ids], np.int64)
        first = (splits >= 0) & np.concatenate(([True], splits[1:] != splits[:-1]))[: len(splits)]
        return np.array(got.ids, np.int64), np.where(first & enc.looks_ahead, at, -1)
    data = np.frombuffer(text, np.uint8)
    inside = ~_SPACE[data]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    packed = enc.words(text.split())
    lengths = np.fromiter(map(len, packed), np.int64, len(packed)) // enc.dtype.itemsize
    off = np.full(int(lengths.sum()), -1)
    some = lengths > 0
    off[(np.cumsum(lengths) - lengths)[some]] = starts[some]
    return np.frombuffer(b"".join(packed), enc.dtype).astype(np.int64), off


def _start(text: bytes, at: int) -> int:
    """The start of the UTF-8 sequence that holds byte at."""
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def windows(text: bytes, chunk: int, overlap: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(k, cuts, first byte, bytes) of each window; cuts are at multiples of chunk."""
    n = max(1, -(-len(text) // chunk))
    for k in range(n):
        a = _start(text, max(0, k * chunk - overlap))
        b = _start(text, min(len(text), (k + 1) * chunk + overlap))
        yield k, n, a, text[a:b]


def edges(window: bytes, first: int, cut: int, overlap: int, ids: np.ndarray, off: np.ndarray) -> dict[int, tuple[int, tuple]]:
    """Byte -> (tokens before it, the next tokens) for the stable bytes around a cut."""
    lo, hi = max(1, cut - overlap - first), min(len(window), cut + overlap - first)
    out = {}
    for i in np.flatnonzero((off >= lo) & (off < hi)).tolist():
        p = int(off[i])
        after = off[i + AGREE :]
        if i + AGREE < len(ids) and window[p] < 0x80 and (len(ids) - i > 2 * AGREE or (after >= 0).any()):
            out[p + first] = i, tuple(ids[i : i + AGREE].tolist())
    return out


def splice(left: dict, right: dict) -> tuple[int, int] | None:
    """Tokens before the first byte at which both encodings agree: in the left window, in the right."""
    for p in sorted(left.keys() & right.keys()):
        if left[p][1] == right[p][1]:
            return left[p][0], right[p][0]
    return None


def count(text: bytes, enc, chunk: int, overlap: int) -> int:
    """Tokens of one text, window by window; each cut is spliced, or all are made again with more overlap."""
    while len(text) > chunk and overlap < len(text):
        total, right = 0, None
        for k, n, a, w in windows(text, chunk, overlap):
            ids, off = encode_with_offsets(w, enc)
            if k:
                got = splice(right, edges(w, a, k * chunk, overlap, ids, off))
                if got is None:
                    break
                total += got[0] - got[1]
            if k + 1 < n:
                right = edges(w, a, (k + 1) * chunk, overlap, ids, off)
            else:
                return total + len(ids)
        overlap *= 2
    return len(enc.packed(text)) // enc.dtype.itemsize


def _short(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            got = b.column("text").to_pylist()
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_bytes": pa.array(map(len, got), pa.int64()), "n_tokens": pa.array([count(t, enc, chunk, overlap) for t in got], pa.int64())})

    return run


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
                for k, n, a, w in windows(text.as_py(), chunk, overlap):
                    yield pa.record_batch({"key": [key], "k": pa.array([k], pa.int64()), "n": pa.array([n], pa.int64()), "first": pa.array([a], pa.int64()), "text": pa.array([w], pa.binary())})

    return run


_EDGES = "array<struct<at: long, before: long, next: string>>"


def _encode(path: str, chunk: int, overlap: int):
    kind = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64()), ("next", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            total, sides = [], ([], [])
            for k, n, a, w in zip(*(b.column(c).to_pylist() for c in ("k", "n", "first", "text")), strict=True):
                ids, off = encode_with_offsets(w, enc)
                total.append(len(ids))
                for side, cut, wanted in ((0, k, k > 0), (1, k + 1, k + 1 < n)):
                    got = edges(w, a, cut * chunk, overlap, ids, off) if wanted else {}
                    sides[side].append([{"at": p, "before": i, "next": repr(t)} for p, (i, t) in sorted(got.items())])
            yield pa.record_batch({"key": b.column("key"), "k": b.column("k"), "n": b.column("n"), "total": pa.array(total, pa.int64()), "left": pa.array(sides[0], kind), "right": pa.array(sides[1], kind)})

    return run


def _splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        gain = []
        for left, right in zip(b.column("before").to_pylist(), b.column("after").to_pylist(), strict=True):
            got = splice({x["at"]: (x["before"], x["next"]) for x in left}, {x["at"]: (x["before"], x["next"]) for x in right})
            gain.append(None if got is None else got[0] - got[1])
        yield pa.record_batch({"key": b.column("key"), "gain": pa.array(gain, pa.int64())})


def _long(docs: DataFrame, path: str, chunk: int, overlap: int, scratch: common.Scratch) -> DataFrame:
    """key, n_tokens of documents that are cut."""
    spark, found, longest = docs.sparkSession, [], docs.agg(F.max(F.octet_length("text"))).first()[0]
    while True:
        name = f"windows{len(found)}"
        cut = docs.mapInArrow(_cut(chunk, overlap), "key string, k long, n long, first long, text binary")
        parts = scratch.write(
            cut.repartition("key", "k").mapInArrow(_encode(path, chunk, overlap), f"key string, k long, n long, total long, left {_EDGES}, right {_EDGES}"),
            name,
        )
        pairs = parts.filter("k + 1 < n").select("key", "k", F.col("right").alias("before")).join(parts.filter("k > 0").select("key", (F.col("k") - 1).alias("k"), F.col("left").alias("after")), ["key", "k"])
        gains = scratch.write(pairs.mapInArrow(_splice, "key string, gain long"), f"gains{len(found)}")
        failed = gains.filter("gain is null").select("key").distinct()
        whole = parts.filter("k = n - 1").select("key", "total")
        sums = gains.groupBy("key").agg(F.sum("gain").alias("gain"))
        found.append(whole.join(failed, "key", "left_anti").join(sums, "key", "left").select("key", (F.col("total") + F.coalesce("gain", F.lit(0))).alias("n_tokens")))
        if not failed.take(1):
            break
        docs = docs.join(failed, "key", "left_semi")
        overlap *= 2
        if overlap >= longest:  # one window for each document
            chunk = longest
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def count_tokens(docs: DataFrame, *, tokenizer: str | None = None, chunk_bytes: int = CHUNK_BYTES, deal_bytes: int = DEAL_BYTES, overlap: int = OVERLAP, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row (documents: doc_id, text)."""
    spark, path = docs.sparkSession, tokenizer or default_path()
    common.ship(spark)
    docs = common.texts(docs)
    size = F.octet_length("text")
    out = docs.filter(size <= deal_bytes).mapInArrow(_short(path, chunk_bytes, overlap), "doc_id long, n_bytes long, n_tokens long")
    large = docs.filter(size > deal_bytes)
    scratch = common.Scratch(spark, "token_counts")
    keys = scratch.write(large.select("doc_id", size.cast("long").alias("n_bytes"), F.sha2("text", 256).alias("key")), "keys")
    if keys.take(1):
        once = large.select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])
        out = out.unionByName(keys.join(_long(once, path, deal_bytes, overlap, scratch), "key").select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
