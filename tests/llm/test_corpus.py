"""Sharding, language-model scoring and the pipeline against brute force."""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import FOLDER, WORD, folded, tricky_rows
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tessera.llm import hmm, sharding
from tessera.llm import queries as llm_queries


def needed(sizes: list[int], capacity: int) -> int:
    shards, used = 1, 0
    for x in sizes:
        if used + x > capacity:
            shards, used = shards + 1, 0
        used += x
    return shards


def check_shards(rows, got, shards=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    where, slots, total = {}, defaultdict(list), Counter()
    for r in got:
        assert where.setdefault((r.size, r.text_crc32), r.shard) == r.shard and 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    weight, first = Counter(), {}
    for d, t in rows:
        t = t or ""
        weight[t] += len(t.encode()) + 1
        first[t] = min(first.get(t, 1 << 62), -(1 << 62) if d is None else d)
    import hashlib

    order = [weight[t] for t in sorted(weight, key=lambda t: (first[t], hashlib.sha256(t.encode()).hexdigest()))]
    best = next(c for c in itertools.count(max([*order, -(-sum(order) // shards)])) if needed(order, c) <= shards)
    assert max(total.values()) == best


def test_shards(tricky):
    check_shards(tricky_rows(), sharding.shard(tricky).collect())


@pytest.mark.parametrize("rows", [1 << 15, 30])
def test_shards_of_documents(documents, pairs, rows, monkeypatch):
    """By an index of one level and of several, of which the driver gets no more rows than a level may add."""
    levels, plain = [], sharding._Sums.part_again

    def spied(self, wanted):
        before = len(self.runs)
        plain(self, wanted)
        levels.append(len(self.runs) - before + len(wanted))

    monkeypatch.setattr(sharding._Sums, "part_again", spied)
    check_shards(pairs, sharding.shard(documents, rows=rows).collect())
    assert levels and max(levels) <= rows and (len(levels) > 1) == (rows == 30)


def test_one_text_that_weighs_most(spark):
    rows = [(i, "x" * (5_000 if i % 3 == 0 else i % 7)) for i in range(200)] + [(300, "y" * 400_000)]
    check_shards(rows, sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows=4).collect())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(1, 9), st.integers(1, 6))
def test_levels_find_the_cuts(sizes, shards, parts):
    """Runs parted here as part_again does it on the executors."""
    cut = [sizes[len(sizes) * p // parts : len(sizes) * (p + 1) // parts] for p in range(parts)]
    sums = sharding._Sums.__new__(sharding._Sums)
    ends = list(itertools.accumulate(sizes))
    at = list(itertools.accumulate([0, *map(len, cut)]))
    sums.runs = [sharding._Run(ends[at[p + 1] - 1], p, 0, len(cut[p])) for p in range(parts) if cut[p]]

    def part_again(wanted):
        sums.runs = [x for i, r in enumerate(sums.runs) for x in ([sharding._Run(ends[at[r.part] + b - 1], r.part, a, b) for a, b in ((r.first, (r.first + r.beyond) // 2), ((r.first + r.beyond) // 2, r.beyond))] if i in wanted else [r])]
        sums.ends = [r.end for r in sums.runs]

    sums.rows, sums.ends, sums.part_again = 4, [r.end for r in sums.runs], part_again
    found = sums.cuts(max(sizes), shards)
    best = next(c for c in itertools.count(max([*sizes, -(-sum(sizes) // shards)])) if needed(sizes, c) <= shards)
    assert found[-1] == sum(sizes) and set(found) <= set(ends) and max(b - a for a, b in zip([0, *found], found)) == best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(1, 9))
def test_smallest_capacity(sizes, shards):
    import bisect

    ends = list(itertools.accumulate(sizes))
    last = lambda x: ends[i - 1] if (i := bisect.bisect_right(ends, x)) else 0
    got = sharding.smallest_capacity(last, ends[-1], max(sizes), shards, ends[-1])
    assert needed(sizes, got) <= shards and (got == max(sizes) or needed(sizes, got - 1) > shards)


def counted(rows):
    c, tokens = Counter(), []
    for d, t in rows:
        w = [*WORD.findall(folded(t or "")), None]
        held = d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        tokens.append((d, held, w))
        if not held:
            c.update(w)
    return c, tokens


@pytest.mark.parametrize("table", [hmm.TABLE, 40])
def test_base_scores(tricky, table):
    c, tokens = counted(tricky_rows())
    n, v = sum(c.values()), len(c)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.held_out, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in hmm.score(tricky, own=20, table=table, states=2).collect())
    want = [(d is not None, d or 0, len(w), h, sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 5)) for d, h, w in tokens]
    assert [g[:6] for g in got] == [w[:6] for w in sorted(want)]
    assert all(abs(g[6] - w[6]) < 1e-4 for g, w in zip(got, sorted(want), strict=True))


def plain_scores(rows, own, states, rounds):
    """log10 probabilities by a plain Baum-Welch over whole documents, token by token."""
    from tessera.llm.wordhash import FOLDED

    def cut(t):
        data = np.frombuffer(folded(t or "").encode(), np.uint8)
        s, e, _ = FOLDED.spans(data, np.array([0, len(data)]))
        return list(zip(FOLDED.hashes(data, s, e).tolist(), hmm.buckets(data, s, e).tolist())) if len(s) else []

    texts = [(d is not None and zlib.crc32(str(d).encode()) % 7 == 2, cut(t)) for d, t in rows]
    count = Counter(w for held, x in texts if not held for w in x)
    top = sorted(count, key=lambda w: (-count[w], w[0] - (1 << 64) * (w[0] >> 63)))[:own]
    mine = {w: 1 + i for i, w in enumerate(w for w in top if count[w] >= hmm.OWN_LEAST)}
    tokens, kinds = Counter(), Counter()
    for w, n in count.items():
        if w not in mine:
            tokens[w[1]] += n
            kinds[w[1]] += 1
    size = 1 + len(mine) + hmm.BUCKETS
    ends = sum(not held for held, _ in texts)
    share = np.array([ends, *(count[w] for w in mine), *(tokens[b] for b in range(hmm.BUCKETS))], float) + 1
    share /= share.sum()
    class_ = lambda w: mine.get(w, 1 + len(mine) + w[1])
    coded = [(held, [*map(class_, x), 0], x) for held, x in texts]
    guess = hmm.Model.guess(share, states)
    start, move, emit = guess.start, guess.move, guess.emit

    def alphas(x):
        out, log = [], 0.0
        for i, c in enumerate(x):
            a = emit[c] * (start if i == 0 else out[-1] @ move)
            log += math.log10(a.sum())
            out.append(a / a.sum())
        return out, log

    for _ in range(rounds):
        s, m, e = np.zeros(states), np.zeros((states, states)), np.zeros((size, states))
        for held, x, _ in coded:
            if held:
                continue
            alpha, _ = alphas(x)
            beta = np.ones(states)
            for i in range(len(x) - 1, -1, -1):
                g = alpha[i] * beta
                e[x[i]] += g / g.sum()
                if i == 0:
                    s += g / g.sum()
                else:
                    xi = alpha[i - 1][:, None] * move * (emit[x[i]] * beta)
                    m += xi / xi.sum()
                    beta = move @ (emit[x[i]] * beta)
                    beta /= beta.sum()
        start = (s + hmm.MOVES) / (s + hmm.MOVES).sum()
        move = (m + hmm.MOVES) / (m + hmm.MOVES).sum(1, keepdims=True)
        emit = e + hmm.PRIOR * share[:, None]
        emit /= emit.sum(0)
    rare = lambda w: 0.0 if w in mine else math.log10((count[w] or max(1, kinds[w[1]])) / max(1, tokens[w[1]] + kinds[w[1]]))
    return [alphas(x)[1] + sum(map(rare, words)) for _, x, words in coded]


@pytest.mark.parametrize("piece", [1_024, 7])
def test_scores_are_those_of_a_plain_baum_welch(spark, tricky, monkeypatch, piece):
    rows = tricky_rows()
    want = sorted((d is not None, d or 0, round(s, 3), s) for (d, _), s in zip(rows, plain_scores(rows, 30, 2, 3)))
    if piece == 7:  # in the test's own process, where the setting holds
        texts = [np.array(x, "<u2") for x in ([1, 2, 3, 4, 0] * 9, [5, 0], [1, 0] * 30, [0])]
        model = hmm.Model.guess(np.full(6, 1 / 6), 3)
        whole = hmm.expect(model, texts), hmm.forward(model, texts)
        monkeypatch.setattr(hmm, "PIECE", piece)
        cut = hmm.expect(model, texts), hmm.forward(model, texts)
        assert all(np.allclose(a, b, rtol=1e-12) for a, b in zip((*whole[0], whole[1]), (*cut[0], cut[1])))
        return
    got = sorted((r.doc_id is not None, r.doc_id or 0, round(r.score, 3), r.score) for r in hmm.score(tricky, own=30, states=2, rounds=3).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[3] - w[3]) <= 1e-6 * abs(w[3]) for g, w in zip(got, want))


def test_scores_are_better_than_the_base_on_held_out_documents(documents):
    rows = hmm.score(documents).collect()
    held = [r for r in rows if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > sum(r.base_score for r in held) / n + 0.2


def test_scores_do_not_hang_on_the_table(documents):
    a, b = ({r.doc_id: r for r in hmm.score(documents, own=300, table=t, states=2, rounds=1).collect()} for t in (hmm.TABLE, 500))
    assert all(abs(a[k].base_score - b[k].base_score) < 1e-6 * abs(a[k].base_score) and abs(a[k].score - b[k].score) < 1e-6 * abs(a[k].score) for k in a)


def test_every_round_reads_all_training_tokens(spark, monkeypatch):
    """No round on a sample or on the start of long documents: the first one over the corpus starts from the guess."""
    seen, whole = [], hmm._round

    def spied(model, training, share):
        lengths = sorted(len(r.classes) // 2 for r in training.collect())
        seen.append((np.array_equal(model.emit, hmm.Model.guess(share, len(model.start)).emit), lengths))
        return whole(model, training, share)

    monkeypatch.setattr(hmm, "_round", spied)
    df = spark.createDataFrame([(i, f"a b c {i % 7} " * (10 + (i == 5) * 5_000)) for i in range(1_500)], "doc_id long, text string")
    rows = hmm.score(df, states=2).collect()
    lengths = sorted(r.n_tokens for r in rows if not r.held_out)
    assert lengths[-1] > 20_000 and len(lengths) > 1_000
    assert seen == [(i == 0, lengths) for i in range(14)]


MODEL = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), np.array([[0.5, 0.1], [0.2, 0.3], [0.3, 0.6]]))


def paths(x):
    for z in itertools.product(range(2), repeat=len(x)):
        p = MODEL.start[z[0]] * MODEL.emit[x[0], z[0]]
        for i in range(1, len(x)):
            p *= MODEL.move[z[i - 1], z[i]] * MODEL.emit[x[i], z[i]]
        yield z, p


SEQUENCES = [np.array(x, "<u2") for x in ([0, 1, 2, 2, 0], [2], [1, 1], [0, 0, 0, 1])]


def test_forward_sums_over_all_paths():
    assert np.allclose(hmm.forward(MODEL, SEQUENCES), [math.log(sum(p for _, p in paths(x))) for x in SEQUENCES])
    long = np.tile(np.array([0, 1, 2], "<u2"), 20_000)
    assert np.isfinite(hmm.forward(MODEL, [long])).all()


def test_expected_counts(monkeypatch):
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((3, 2))
    for x in SEQUENCES:
        total = sum(p for _, p in paths(x))
        for z, p in paths(x):
            start[z[0]] += p / total
            for i, c in enumerate(x):
                emit[c, z[i]] += p / total
                if i:
                    move[z[i - 1], z[i]] += p / total
    for limit in (1 << 18, 3):
        monkeypatch.setattr(hmm, "BATCH", limit)
        for got, want in zip(hmm.expect(MODEL, SEQUENCES), (start, move, emit), strict=True):
            assert np.allclose(got, want)


def test_long_sequences_side_by_side_need_no_products(monkeypatch):
    """Products over pieces cost as much as several passes; windows in time, pieces and runs change no count."""
    rng = np.random.default_rng(3)
    data = [rng.integers(0, 6, n).astype("<u2") for n in (*[2_000] * 300, *rng.integers(1, 400, 300), 5_000)]
    model, asked, plain = hmm.Model.guess(np.full(6, 1 / 6), 3), [], hmm._products
    monkeypatch.setattr(hmm, "_products", lambda m, pieces, heads: asked.append(sum(map(len, pieces))) or plain(m, pieces, heads))
    got = *hmm.expect(model, data), hmm.forward(model, data)
    assert sum(asked) < 0.5 * sum(map(len, data)), asked
    for changed in ({"WIDE": 10**9}, {"WIDE": 1}, {"BATCH": 5_000, "HELD": 3_000}, {"RUN": 40_000, "MOST": 7}):
        with monkeypatch.context() as m:
            for name, value in changed.items():
                m.setattr(hmm, name, value)
            assert all(np.allclose(a, b, rtol=1e-10) for a, b in zip(got, (*hmm.expect(model, data), hmm.forward(model, data)))), changed


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(1)
    data = [np.where(rng.random(60) < 0.9, rng.integers(0, 3, 60) + 3 * (i % 2), rng.integers(0, 6, 60)).astype("<u2") for i in range(40)]
    share = np.full(6, 1 / 6)
    model = hmm.Model.guess(share, 2)
    before = hmm.forward(model, data).sum()
    for _ in range(15):
        model = hmm.Model.fit(*hmm.expect(model, data), share)
    assert hmm.forward(model, data).sum() > before + 100


def test_nothing(nothing):
    assert sharding.shard(nothing).count() == hmm.score(nothing).count() == 0


def test_pipeline(spark):
    """Each stage against brute force over what the one before kept."""
    from test_copies import grouped, kept_hash, removed
    from test_rules import leaks, measures
    from test_tokens import ids

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    rows = [r for r in rows if measures(r[1])[-1]]
    least = grouped(rows)
    rows = [r for r in rows if least[r[0]] == r[0]]
    cut = removed(rows, 20)
    stays = {d: [x for i, x in enumerate(w) if i not in gone] for (d, _), (w, gone) in cut.items()}
    rows = [(d, " ".join(w)) for d, w in sorted(stays.items()) if w]
    rows = [r for r, x in zip(rows, leaks(rows, bench), strict=True) if not x[5]]
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        got[r.doc_id] += r.length
    assert got == {d: len(ids(t)) + 1 for d, t in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name


def test_stages_take_what_is_tricky(spark, tricky, nothing):
    for docs in (tricky, nothing):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            out.write.format("noop").mode("overwrite").save()


def test_every_operator_has_a_query():
    names = llm_queries.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
