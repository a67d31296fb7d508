"""Token counts, token files and packing against the tokenizers library."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import tricky_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing, token_counts, token_files
from tessera.llm.encoder import default_path, encoder

TK = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids(text: str | None) -> list[int]:
    return TK.encode(text or "", add_special_tokens=False).ids


def crc(x: list[int]) -> int:
    return zlib.crc32(np.array(x, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.lists(st.sampled_from(["<|endoftext|>", "'s", "Don't", "ÀÉ", "é", "é", "́", "12", "ΣΑΣ", "İ", " ", "\n", "\x1c", " ", "!!", "a"]), max_size=12).map("".join))
def test_words_give_the_library_s_ids(text):
    assert encoder(default_path()).ids(text.encode()).tolist() == ids(text)


@pytest.mark.parametrize("file", ["byte_bpe_50k.json"])
def test_other_files_go_by_the_library(file):
    path = public_tokenizers.path(file)
    enc = encoder(path)
    assert not enc.by_word
    assert enc.ids("Some text, and more.".encode()).tolist() == Tokenizer.from_file(path).encode("Some text, and more.", add_special_tokens=False).ids


@pytest.mark.parametrize("chunk, deal, overlap", [(1 << 12, 1 << 16, 256), (300, 300, 4), (200, 1000, 64)])
def test_counts(tricky, chunk, deal, overlap):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(tricky, chunk_bytes=chunk, deal_bytes=deal, overlap=overlap).collect())
    want = [(d, len((t or "").encode()), len(ids(t))) for d, t in tricky_rows()]
    assert got == sorted((d is not None, d or 0, b, n, n > 2048) for d, b, n in want)


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_splices_are_stable(file):
    enc = encoder(public_tokenizers.path(file))
    text = ("alpha beta, gamma " * 200 + "é" * 50 + " delta").encode()
    found = list(token_counts.windows(text, 256, 32))
    assert found[0][1] == len(found) and b"".join(w[(k * 256 - a) if k else 0 : (k + 1) * 256 - a] for k, _, a, w in found) == text
    _, off = token_counts.encode_with_offsets(text, enc)
    _, _, a, w = found[1]
    got = token_counts.edges(w, a, 256, 32, *token_counts.encode_with_offsets(w, enc))
    assert got and any(p in off for p in got)
    assert token_counts.splice({5: (1, "x")}, {5: (2, "y")}) is None
    assert token_counts.splice({5: (1, "x"), 9: (3, "z")}, {5: (2, "y"), 9: (1, "z")}) == (3, 1)


_BITS = ["<|endoftext|>", "'s", "Don't", "ÀÉ", "e\u0301", "12345678", "ΣΑΣ", " ", "  ", "\n", "\n\n ", "\u00a0", "\u2003", "!!", "a", "word ", " the", "\t", "漢字", "🙂", "xxxxxxxxxxxx"]


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@settings(max_examples=150, deadline=None)
@given(parts=st.lists(st.sampled_from(_BITS), min_size=20, max_size=90), chunk=st.integers(8, 60), overlap=st.integers(2, 40))
def test_spliced_counts_are_the_library_s(file, parts, chunk, overlap):
    enc, text = encoder(public_tokenizers.path(file)), "".join(parts)
    assert enc.by_word or enc.looks_ahead
    assert token_counts.count(text.encode(), enc, chunk, overlap) == len(enc.tk.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_prose_is_spliced_not_encoded_whole(file, pairs, monkeypatch):
    enc = encoder(public_tokenizers.path(file))
    long = [t.encode() for _, t in pairs if t and len(t.encode()) > 4096]
    want = [len(enc.tk.encode(t.decode(), add_special_tokens=False).ids) for t in long]
    monkeypatch.setattr(enc, "packed", None)
    assert len(long) > 5 and [token_counts.count(t, enc, 4096, 256) for t in long] == want


def test_files_round_trip(tricky, tmp_path):
    got = [tuple(r) for r in token_files.token_files(tricky, folder=f"file://{tmp_path}/ids").collect()]
    rows = {(d, crc([*ids(t), 2])): len(ids(t)) + 1 for d, t in tricky_rows()}
    assert sorted((d is not None, d or 0, n, c) for d, _, n, c in got) == sorted((d is not None, d or 0, len(ids(t)) + 1, crc([*ids(t), 2])) for d, t in tricky_rows())
    at = 0
    for d, start, n, c in sorted(got, key=lambda r: r[1]):
        assert start == at and rows[d, c] == n
        at += n
    order = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert [d for d in order if d is not None] == sorted(d for d in order if d is not None) and order[:2] == [None, None]
    again = token_files.read_ids(token_files.manifest(tricky.sparkSession, f"file://{tmp_path}/ids"), f"file://{tmp_path}/ids")
    assert sorted(map(repr, (tuple(r) for r in again.collect()))) == sorted(map(repr, got))


def test_parts_follow_the_size_and_split_equal_ids(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = tmp_path / "ids"
    folder.mkdir()
    (folder / "part-00000-left.ids").write_bytes(b"x")  # of an attempt that was lost
    df = spark.range(3_000).select(F.lit(7).alias("doc_id"), F.lit("one two three four").alias("text"))
    parts = token_files.write_ids(df, f"file://{folder}", part_bytes=8_000)
    rows = parts.collect()
    assert len(rows) >= 3 and max(r.n_docs for r in rows) < 2_000 and sum(r.n_docs for r in rows) == 3_000
    assert sorted(p.name for p in folder.iterdir()) == sorted(["manifest.json", *(f"{r.file}.{k}" for r in rows for k in ("ids", "idx"))])
    got = sorted(r.start for r in token_files.read_ids(parts, f"file://{folder}").collect())
    assert got == list(range(0, 3_000 * (len(ids("one two three four")) + 1), len(ids("one two three four")) + 1))


def test_half_of_the_ids_is_put_in_order_at_once(spark, tricky, tmp_path, monkeypatch):
    many = spark.createDataFrame([(i * 7 % 1_000, f"one two {i}") for i in range(1_000)], "doc_id long, text string")
    sizes, plain = [], token_files._written
    monkeypatch.setattr(token_files, "HALVED", 0)
    monkeypatch.setattr(token_files, "_written", lambda rows, *x: sizes.append(rows.count()) or plain(rows, *x))
    for name, df in (("many", many), ("tricky", tricky.select("doc_id", "text")), ("one", many.selectExpr("7L AS doc_id", "text")), ("null", many.selectExpr("CAST(NULL AS LONG) AS doc_id", "text"))):
        sizes.clear()
        folder = f"file://{tmp_path}/{name}"
        got = sorted((tuple(r) for r in token_files.token_files(df, folder=folder).collect()), key=lambda r: r[1])
        rows = [tuple(r) for r in df.collect()]
        assert sum(sizes) == len(rows) and (name != "many" or max(sizes) < 600), sizes
        key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
        assert sorted(((d, n, c) for d, _, n, c in got), key=key) == sorted(((d, len(ids(t)) + 1, crc([*ids(t), 2])) for d, t in rows), key=key)
        assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
        assert [(r[0] is not None, r[0] or 0) for r in got] == sorted((r[0] is not None, r[0] or 0) for r in got)
        parts = sorted(r.part for r in token_files.manifest(spark, folder).collect())
        assert len(set(parts)) == len(parts)


def test_packing(tricky):
    rows = packing.pack(tricky, length=128, group=60).collect()
    want = defaultdict(int)
    for d, t in tricky_rows():
        want[d, len(ids(t)) + 1] += len(ids(t)) + 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 128
    texts = {d: [*ids(t), 2] for d, t in tricky_rows() if d == 40}
    assert all(r.ids_crc32 == crc(texts[40][r.start : r.start + r.length]) for r in rows if r.doc_id == 40)


def test_repeated_rows_do_not_fill_one_group(spark):
    from pyspark.sql import functions as F

    rows = packing.pack(spark.range(60_000).select(F.lit(7).alias("doc_id"), F.lit("a b c").alias("text")))
    sizes = [r["count"] for r in rows.groupBy(F.col("sequence_id").bitwiseAND(F.lit(-1 << 32)).alias("g")).count().collect()]
    assert len(sizes) == 3 and max(sizes) < 25_000


def test_packing_carries_ids_and_wastes_little(documents, pairs):
    rows = packing.pack(documents, with_ids=True).collect()
    by = {d: [*ids(t), 2] for d, t in pairs}
    assert all(np.frombuffer(r.ids, "<u4").tolist() == by[r.doc_id][r.start : r.start + r.length] for r in rows)
    used = sum(r.length for r in rows)
    assert used / 4096 <= len({r.sequence_id for r in rows}) <= used / 4096 + 1.5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_first_fit_decreasing(sizes):
    bins, offsets = packing.first_fit_decreasing(np.array(sizes, np.int64), 20)
    free, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((k for k, f in enumerate(free) if f >= sizes[i]), None)
        if b is None:
            b = len(free)
            free.append(20)
        want[i] = b, 20 - free[b]
        free[b] -= sizes[i]
    assert {i: (int(b), int(o)) for i, (b, o) in enumerate(zip(bins, offsets, strict=True))} == want


def test_nothing(nothing):
    assert token_counts.count_tokens(nothing).count() == token_files.token_files(nothing).count() == packing.pack(nothing).count() == 0
