"""Token ids as flat binary files: write, commit, memory-map, read back.

Layout of one output folder: ``part-NNNNN-<mark>.ids`` holds the ids of a run of
documents, each with its end id, as little-endian unsigned integers (16 bits
where the vocabulary allows, else 32); ``part-NNNNN-<mark>.idx`` holds, as
little-endian 64-bit integers, pairs (doc_id, offset of its first id within
the part) and a last pair (count of documents, count of ids). Parts hold
ascending ranges of doc_id, about ``part_bytes`` of ids each; the base of a part
is the prefix sum of the parts before it. The mark is that of the task attempt
that wrote the files; ``manifest.json`` names the files of the attempts that
count, and what other attempts left is deleted. So a lost executor leaves no
half part, and nothing is renamed.

Documents are encoded where they lie; their packed ids, which are smaller than
the texts, are put in order, the lower half of the ids first, so that no more
than about a half lies in shuffle files at once. Equal ids are ordered by a hash
of their ids, and equal documents by their row, so that no range is one id's
alone.

Null and empty texts have the end id alone; a very long text is one document of
a larger part; null ids come first and read back as null; repeated rows are
written each time; an empty table gives a manifest without parts; extra columns
are ignored.
"""

from __future__ import annotations

import json
import mmap
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .encoder import default_path, encoder, fingerprint

#: Stands for a null id in the index.
NO_ID = -(2**63)
#: Bytes of ids in a part, about; fewer where there would be too few parts to keep all cores busy, but no fewer than the second.
PART_BYTES = 1 << 26
LEAST_BYTES = 1 << 20
#: Fewer bytes of ids are put in order at once.
HALVED = 1 << 24


def _place(uri: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system, path


def _encoded(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        for b in batches:
            ids = [enc.packed(t.as_py()) + end for t in b.column("text")]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "ids": pa.array(ids, pa.binary())})

    return run


def _writer(folder: str, width: int, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first + TaskContext.get().partitionId()
        system, top = _place(folder)
        name = f"part-{part:05d}-{uuid.uuid4().hex}"
        index, at, docs = [], 0, 0
        with system.open_output_stream(f"{top}/{name}.ids") as ids, system.open_output_stream(f"{top}/{name}.idx") as idx:
            for b in batches:
                for doc, packed in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                    ids.write(packed.as_buffer())
                    index += (NO_ID if doc is None else doc, at)
                    at += packed.as_buffer().size // width
                    docs += 1
                    if len(index) >= 1 << 16:
                        idx.write(np.array(index, "<i8").tobytes())
                        index = []
            idx.write(np.array([*index, docs, at], "<i8").tobytes())
        if docs:
            yield pa.record_batch({"part": pa.array([part], pa.int64()), "file": pa.array([name]), "n_docs": pa.array([docs], pa.int64()), "n_ids": pa.array([at], pa.int64()), "width": pa.array([width], pa.int64())})

    return run


_PARTS = "part long, file string, n_docs long, n_ids long, width long"


def write_ids(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = 2, part_bytes: int = PART_BYTES) -> DataFrame:
    """Writes the files of docs (doc_id, text) in ascending doc_id order; returns part, file, n_docs, n_ids, width, base.

    One row for each part: the rows are counts of files, not of documents.
    """
    spark, path = docs.sparkSession, tokenizer or default_path()
    common.ship(spark)
    scratch = common.Scratch(spark, "token_ids")
    system, top = _place(folder)
    system.create_dir(top, recursive=True)
    encoded = scratch.write(common.texts(docs).mapInArrow(_encoded(path, end_id), "doc_id long, ids binary"), "encoded", "zstd")
    middle = encoded.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    id_, middle = F.col("doc_id"), F.lit(middle).cast("long")
    lower = id_.isNull() | (id_ < middle)
    size, low = (x or 0 for x in encoded.agg(F.sum(F.octet_length("ids")), F.sum(F.when(lower, F.octet_length("ids")))).first())
    halves = [(encoded.filter(lower), low), (encoded.filter(id_ >= middle), size - low)] if size > HALVED else [(encoded, size)]
    done, parts = [], 0
    for i, (rows, n) in enumerate(halves):
        found = scratch.write(_written(rows, n, folder, encoder(path).dtype.itemsize, parts, part_bytes), f"parts{i}")
        done += sorted(found.collect())
        parts = done[-1].part + 1 if done else 0
    scratch.drop("encoded")
    bases = np.cumsum([0, *(r.n_ids for r in done)])
    found = [(*r, int(b)) for r, b in zip(done, bases[:-1], strict=True)]
    _commit(folder, [r.file for r in done], {"tokenizer": fingerprint(path), "end_id": end_id, "parts": found})
    return spark.createDataFrame(found, f"{_PARTS}, base long")


def _written(rows: DataFrame, size: int, folder: str, width: int, first: int, part_bytes: int) -> DataFrame:
    """Writes the files of rows (doc_id, ids), which have ``size`` bytes of ids, as parts from ``first`` on."""
    parts = max(1, -(-size // part_bytes), min(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), "row"]
    rows = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return rows.select("doc_id", "ids").mapInArrow(_writer(folder, width, first), _PARTS)


def _commit(folder: str, files: list[str], manifest: dict) -> None:
    """Writes the manifest and deletes what it does not name."""
    from pyarrow import fs

    system, top = _place(folder)
    with system.open_output_stream(f"{top}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    named = {f"{x}.{kind}" for x in files for kind in ("ids", "idx")} | {"manifest.json"}
    for x in system.get_file_info(fs.FileSelector(top)):
        if x.base_name.startswith("part-") and x.base_name not in named:
            system.delete_file(x.path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of a folder that was written earlier."""
    system, top = _place(folder)
    with system.open_input_file(f"{top}/manifest.json") as f:
        return spark.createDataFrame([tuple(x) for x in json.loads(f.read())["parts"]], f"{_PARTS}, base long")


class _File:
    """Ranges of a file: memory-mapped where it is local, else read as asked for."""

    def __init__(self, folder: str, name: str):
        system, top = _place(folder)
        self.map = None
        if system.type_name == "local":
            with open(f"{top}/{name}", "rb") as f:
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            self.size = len(self.map)
        else:
            self.file = system.open_input_file(f"{top}/{name}")
            self.size = self.file.size()

    def read(self, a: int, b: int) -> memoryview:
        return memoryview(self.map)[a:b] if self.map is not None else memoryview(self.file.read_at(b - a, a))


#: Documents that one row of the result batch holds.
_ROWS = 4096


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                index, ids, width = _File(folder, f"{row['file']}.idx"), _File(folder, f"{row['file']}.ids"), row["width"]
                n = index.size // 16 - 1
                last = np.frombuffer(index.read(16 * n, 16 * n + 16), "<i8")
                assert (n, ids.size // width) == (last[0], last[1]), "a part does not fit its index"
                for i in range(0, n, _ROWS):
                    j = min(i + _ROWS, n)
                    pairs = np.frombuffer(index.read(16 * i, 16 * j + 16), "<i8").reshape(-1, 2)
                    doc, edge = pairs[:-1, 0], pairs[:, 1]
                    crc = [zlib.crc32(np.frombuffer(ids.read(int(a) * width, int(z) * width), f"<u{width}").astype("<u4").tobytes()) for a, z in zip(edge, edge[1:])]
                    yield pa.record_batch({
                        "doc_id": pa.array(doc, pa.int64(), mask=doc == NO_ID), "start": pa.array(edge[:-1] + row["base"]),
                        "n_tokens": pa.array(np.diff(edge)), "ids_crc32": pa.array(crc, pa.int64()),
                    })

    return run


def read_ids(parts: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    n = max(1, parts.count())
    return parts.repartition(n, "part").mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, *, folder: str | None = None, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes docs to files (in the shared folder unless folder names another) and reads them back."""
    folder = folder or common.Scratch(docs.sparkSession, "token_files").path("ids")
    return read_ids(write_ids(docs, folder, tokenizer=tokenizer, end_id=end_id), folder)
