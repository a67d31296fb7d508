"""Near copies and repeated passages against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from conftest import WORD, folded, tricky_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import jaccard, substrings
from tessera.llm.common import Scratch
from tessera.llm.components import components


def shingles(text: str | None) -> frozenset:
    w = WORD.findall(folded(text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def grouped(rows: list[tuple]) -> dict:
    """Smallest id of the group of each id; rows of one id are one node."""
    nodes: dict = {}
    for d, t in rows:
        nodes.setdefault(d, set()).add(shingles(t))
    least = {d: d for d in nodes if d is not None}
    links = [(a, b) for a, b in combinations(least, 2) if any(100 * len(x & y) >= 75 * len(x | y) for x in nodes[a] for y in nodes[b] if x and y)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= (least[a], least[b]) != (m, m)
            least[a] = least[b] = m
    return least


def check(df, rows):
    least = grouped(rows)
    got = [tuple(r) for r in jaccard.near_copies(df).collect()]
    want = [(d, len(shingles(t)), least.get(d)) for d, t in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_groups(tricky):
    check(tricky, tricky_rows())


def test_groups_of_documents(documents, pairs):
    check(documents, pairs)


@pytest.mark.parametrize("pairs_at_once, progress, long, block, room", [(0, 0.6, 3, 500, 4), (10**9, 0.6, 10**9, 500, 4), (0, -1, 2, 500, 0), (0, -1, 1, 2, 10**9)])
def test_rounds_cells_and_order_lose_no_link(spark, tricky, monkeypatch, pairs_at_once, progress, long, block, room):
    monkeypatch.setattr(jaccard, "PAIR_SHINGLES", room)
    monkeypatch.setattr(jaccard, "PAIRS", pairs_at_once)
    monkeypatch.setattr(jaccard, "PROGRESS", progress)
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", block)
    check(tricky, tricky_rows())


def boilerplate(n: int) -> list[tuple]:
    """Documents of 8 out of 40 sentences, hardly any of which link."""
    import random

    rng = random.Random(n)
    sentences = [" ".join(f"w{i}x{j}" for j in range(10)) for i in range(40)]
    return [(d, " ".join(rng.sample(sentences, 8))) for d in range(n)]


def test_rows_grow_with_boilerplate_not_with_its_pairs(spark, monkeypatch):
    made, plain = Counter(), Scratch.write

    def spied(self, df, name):
        out = plain(self, df, name)
        if any(x in name for x in ("pairs", "asked", "cells", "links")):
            made[len(rows)] += out.count()
        return out

    monkeypatch.setattr(Scratch, "write", spied)
    for n in (4000, 8000):
        rows = boilerplate(n)
        jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).write.format("noop").mode("overwrite").save()
    assert made[8000] < 2.6 * made[4000], made


def test_list_entries_are_joined_when_the_shuffle_files_of_their_counts_are_gone(spark, documents, monkeypatch):
    seen, plain = [], Scratch.write

    def spied(self, df, name):
        if name.endswith("_lists"):
            seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(self, df, name)

    monkeypatch.setattr(Scratch, "write", spied)
    jaccard.near_copies(documents)
    assert len(seen) == 1 and "Join" in seen[0] and "Aggregate" not in seen[0]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([(24, 20), (0, 0), (10**9, 10**9), (0, 10**9)]))
def test_t_occurrence_search_finds_all_links(seed, costs):
    rng = np.random.default_rng(seed)
    base = [rng.choice(60, rng.integers(1, 30), replace=False) for _ in range(4)]
    make = lambda k: [np.unique(np.where(rng.random(len(x)) < 0.93, x, rng.integers(0, 99, len(x)))).astype(np.uint64) for x in (base[i] for i in rng.integers(0, 4, k))]
    left, right = make(rng.integers(1, 15)), make(rng.integers(1, 15))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(jaccard, "HEAP", costs[0])
        m.setattr(jaccard, "PROBE", costs[1])
        for other in (None, right):
            a, b = jaccard.linked(left, other)
            want = {(i, j) for i, x in enumerate(map(set, left)) for j, y in enumerate(map(set, other or left)) if (other or j > i) and 100 * len(x & y) >= 75 * len(x | y)}
            assert sorted(zip(a.tolist(), b.tolist())) == sorted(want)


def test_ids_of_several_texts_lose_no_link(spark):
    """An id with a copy of a smaller id's text and a text of its own that others link with; an id that joins two groups; repeated rows."""
    words = [f"w{i}" for i in range(60)]
    text = lambda k, at: " ".join(f"{k}{w}" if i != at else "x" for i, w in enumerate(words))
    rows = [(1, text("a", 99)), (2, text("a", 99)), (2, text("b", 99)), (3, text("b", 7)), (4, text("c", 5)), (5, text("d", 5)), (6, text("c", 5)), (6, text("d", 5)), (7, text("d", 6))]
    rows += [(8, text("e", 1))] * 40 + [(9, text("e", 2)), (None, text("e", 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(df, rows)
    check_links(df, rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in jaccard.keep_one(df).collect()) == [(True, 1), (True, 4), (True, 8)]


def check_links(df, rows):
    nodes, least = {}, grouped(rows)
    for d, t in rows:
        nodes.setdefault(d, set()).add(shingles(t))
    linked = lambda a, b: any(100 * len(x & y) >= 75 * len(x | y) for x in nodes[a] for y in nodes[b] if x and y)
    n = Counter(x for p in combinations([d for d in nodes if d is not None], 2) if linked(*p) for x in p)
    got = [tuple(r) for r in jaccard.linked_copies(df).collect()]
    want = [(d, len(shingles(t)), least.get(d), n[d]) for d, t in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    return sum(n.values())


@pytest.mark.parametrize("texts_in_block, shingles_in_block", [(500, 1 << 20), (1, 1 << 20), (500, 300)])
def test_all_links_are_counted(spark, monkeypatch, texts_in_block, shingles_in_block):
    """A group of edited copies in which not all link, exact copies among them, and an id that has two of its texts."""
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", texts_in_block)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles_in_block)
    words = [f"w{i}" for i in range(150)]
    edited = [" ".join(w if j // 3 not in range(i, i + 3) else f"x{i}" for j, w in enumerate(words)) for i in range(0, 40, 3)]
    rows = list(enumerate([*edited, edited[0], edited[0], edited[4], "alone here", None, "a b", "A b", "a b"]))
    rows += [(2, edited[9]), (2, edited[2]), (90, "c d"), (90, "a b"), (91, "e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert check_links(df, rows) > 100


def test_links_of_documents(documents, pairs, tricky):
    check_links(documents, pairs)
    check_links(tricky, tricky_rows())


def test_op4_has_links(spark):
    from tessera.llm import queries as llm_queries

    assert llm_queries.queries()["op4_ngram_jaccard"](spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_shingles", "component_id", "n_links"]


def test_keep_one(tricky):
    least = grouped(tricky_rows())
    kept = jaccard.keep_one(tricky)
    assert kept.columns == tricky.columns
    texts = {t for d, t in tricky_rows() if d is not None}
    want = Counter((d, t) for d, t in tricky_rows() if (d is None and t not in texts) or (d is not None and least[d] == d))
    assert Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()) == Counter({(d, t): 1 if WORD.search(t or "") else n for (d, t), n in want.items()} | {(None, None): 1})


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1), st.dictionaries(st.integers(0, 60), st.integers(1, 9)))
def test_linked_sets_share_a_prefix_shingle(a, b, frequent):
    late = np.array(sorted(frequent), np.uint64)
    rank = np.array([frequent[int(x)] for x in late], np.int64)
    if 100 * len(a & b) >= 75 * len(a | b):
        x, y = (set(jaccard.prefix(np.array(sorted(s), np.uint64), late, rank).tolist()) for s in (a, b))
        assert x & y


@pytest.mark.parametrize("links", [[], [(i, i + 1) for i in range(50)], [(7, i) for i in range(40) if i != 7], [(1, 2), (3, 4), (2, 4), (9, 9), (10, 11), (1, 2)]])
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    got = dict(tuple(r) for r in components(df, Scratch(spark, "test")).collect())
    least = {x: x for p in links for x in p if p[0] != p[1]}
    for _ in range(60):
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least


def removed(rows: list[tuple], n: int) -> dict:
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    seen, out = set(), {}
    for row in order:
        w, gone = WORD.findall(row[1] or ""), set()
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            if k in seen:
                gone |= set(range(i, i + n))
            seen.add(k)
        out[row] = w, gone
    return out


def kept_hash(w, gone):
    return hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


def test_repeats(tricky):
    rows, want = tricky_rows(), removed(tricky_rows(), 20)
    got = [tuple(r) for r in substrings.cut_repeats(tricky).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[3])
    assert sorted(got, key=key) == sorted(((d, len(want[d, t][0]), len(want[d, t][1]), kept_hash(*want[d, t])) for d, t in rows), key=key)


def test_repeats_of_documents(documents, pairs):
    want = removed(pairs, 20)
    got = sorted(tuple(r) for r in substrings.cut_repeats(documents).collect())
    assert got == [(d, len(want[d, t][0]), len(want[d, t][1]), kept_hash(*want[d, t])) for d, t in pairs]


def test_texts_without_repeats(tricky):
    want = removed(tricky_rows(), 20)
    got = substrings.cut_texts(tricky)
    assert got.columns == tricky.columns and got.schema["n_chars"].dataType == tricky.schema["n_chars"].dataType
    left = {}
    for r in got.select("doc_id", "text", "n_chars", "`a.b`", "row").collect():
        assert (r["a.b"], r.row) == ("x", "x")
        assert r.n_chars == (None if r.text is None else len(r.text))
        left.setdefault(r.doc_id, []).append(r.text)
    for (d, t), (w, gone) in want.items():
        stays = [x for i, x in enumerate(w) if i not in gone]
        if w and not stays:
            assert not any(WORD.findall(x or "") == [] and x for x in left.get(d, []))
        elif not gone:
            assert t in left[d]
        else:
            assert stays in [WORD.findall(x or "") for x in left[d]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 13))
def test_anchors_are_leftmost_minima(values, width):
    seeds = np.array(values, np.uint64)
    got = substrings.anchors(seeds, width).tolist()
    assert got == [min(range(i, i + width), key=lambda j: (values[j], j)) for i in range(len(values) - width + 1)]


def test_nothing(nothing):
    assert jaccard.near_copies(nothing).count() == jaccard.keep_one(nothing).count() == substrings.cut_repeats(nothing).count() == substrings.cut_texts(nothing).count() == 0


@pytest.mark.parametrize("most", [0, 1, 5, 60, 1000])
def test_most_frequent(spark, most):
    from tessera.llm.common import most_frequent

    counts = [1] * 30 + [2] * 10 + [5, 5, 80, 1000, 10**12]
    df = spark.createDataFrame(list(enumerate(counts)), "word long, n long")
    got = sorted((r.n for r in most_frequent(df, "n", most).collect()), reverse=True)
    assert len(got) <= most and got == sorted(counts, reverse=True)[: len(got)]
    assert len(got) >= min(most, 5) or most < 5
