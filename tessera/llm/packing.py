"""Packing of documents into sequences: first-fit decreasing in randomised groups.

A document's ids (with its end id) are cut into pieces of at most ``length``.
The pieces are written and numbered as they lie there; each is dealt by a hash
of its number to one of enough groups that a group has about ``group`` pieces,
so neither equal ids nor repeated rows fill one group. Each group is packed by
itself: pieces from long to short, each into the leftmost sequence with room,
found in a tournament tree over the sequences' free room.

Null and empty texts are the end id alone. A very long text is many pieces,
written as they are cut. Of equally long pieces the one of the smaller doc_id
(nulls last), start and checksum comes first. Equal ids and repeated rows are
pieces like others. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .encoder import default_path, encoder

#: Pieces in a group, about: the last sequences of a group are the ones that stay part empty.
GROUP = 20_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; the leftmost bin that fits is found by descending a tournament tree."""
    n = len(sizes)
    leaves = 1
    while leaves < max(1, n):
        leaves *= 2
    tree = [capacity] * (2 * leaves)  # each node: the most free room below it
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
    return bins, offsets


def _pieces(tokenizer: str, end_id: int, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            rows, held = [], 0
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.append(enc.ids(text.as_py()), enc.dtype.type(end_id)).astype("<u4")
                for s in range(0, len(ids), length):
                    part = ids[s : s + length]
                    rows.append((doc, s, len(part), zlib.crc32(part.tobytes()), len(ids), part.tobytes() if with_ids else None))
                    held += 48 + len(part) * 4 * with_ids
                    if held > 1 << 23:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)

    return run


_COLUMNS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch({name: pa.array(col, kind) for (name, kind), col in zip(_COLUMNS, zip(*rows, strict=True), strict=True)})


def _pack(length: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), length)
        return group.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(bins + (group.column("pack_group").to_numpy().astype(np.int64) << 32))).append_column("offset", pa.array(offsets))

    return run


def pack(docs: DataFrame, *, tokenizer: str | None = None, length: int = 4096, end_id: int = 2, group: int = GROUP, seed: int = 7, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for)."""
    spark = docs.sparkSession
    common.ship(spark)
    scratch = common.Scratch(spark, "packing")
    pieces = scratch.write(common.texts(docs).mapInArrow(_pieces(tokenizer or default_path(), end_id, length, with_ids), _DDL), "pieces")
    n = pieces.count()
    groups = max(1, round(n / group))
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), F.lit(groups)))  # of a written table: the same in each attempt
    out = dealt.groupBy("pack_group").applyInArrow(_pack(length), f"{_DDL}, sequence_id long, offset long")
    return out if with_ids else out.drop("ids")
