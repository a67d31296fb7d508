"""A hidden Markov language model: Baum-Welch over all training documents, exact scoring.

Tokens are lower-cased (A-Z) words and one end for each document. Every
training token is counted; the counts stay in a distributed table.

The model: latent states emit classes. The OWN most frequent words and the end
are a class each; every other word belongs to the class of its BUCKETS bucket
(a hash of its first and last bytes) and is drawn from it by its own count
(Witten-Bell: known words share C / (C + V), the unknown one has V / (C + V),
with C tokens and V words in the bucket). So P(text) = P(classes) times the
words' shares, a proper probability over words and one unknown for each bucket.

Training: from a random first guess around the corpus' class shares, ROUNDS
iterations of Baum-Welch run over all training documents, expected counts being
added up in each task and summed across partitions. Every training document is
one sequence, however long: the pieces in which a long one is computed start and
end with the exact forward and backward numbers. Scoring is the scaled forward
recursion over the whole document. Row order and layout change nothing but the
last digits of sums.

Only the classes' parameters, bounded by OWN and BUCKETS, and the counts of the
TABLE most frequent words go to the tasks; all rarer words are counted and
scored by a join on the word.

Null and empty texts are an end alone. A null id counts as training. Repeated
rows are scored each. An empty table gives no rows; without training rows all
is unknown. Of equally frequent words at the bound of the OWN ones those of the
smaller hash have a class. Extra columns are ignored. Words are compared by
64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .wordhash import FOLDED, U, groups

STATES = 6
OWN = 30_000
#: Words of fewer training tokens have no class of their own, however few words there are.
OWN_LEAST = 5
BUCKETS = 512
TABLE = 200_000
ROUNDS = 14
#: Tokens of a piece of a long document at least; longer pieces while so many sequences run side by side, which is less work than products over pieces.
PIECE = 1_024
WIDE = 256
#: Steps between two scalings of a product.
RESCALE = 8
#: Tokens, and sequences, that run side by side, as each time step has its price; tokens whose forward and backward numbers are held at once; tokens whose chances of states are.
RUN = 1 << 23
MOST = 1 << 13
BATCH = 1 << 16
HELD = 1 << 18
#: Training tokens of one task of a round at most, about. Each task returns a row for each class, and long sequences need others beside them, so few large tasks cost least.
TASK_TOKENS = 1 << 27
#: Pseudo-tokens of the corpus' own class shares in each state, and of uniform moves between states.
PRIOR = 200.0
MOVES = 1.0


def buckets(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bucket of each word, by its first two and last two folded bytes."""
    low = np.arange(256, dtype=np.int64)
    low[65:91] += 32
    size = end - start
    a, b = low[data[start]], np.where(size > 1, low[data[np.minimum(start + 1, end - 1)]], 0)
    y, z = np.where(size > 1, low[data[np.maximum(end - 2, start)]], 0), low[data[end - 1]]
    mixed = (((a * 257 + b) * 257 + y) * 257 + z).astype(U) * U(0x9E3779B97F4A7C15)
    return (mixed >> U(40)).astype(np.int64) % BUCKETS


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, bucket, n: counts of runs of rows."""
    words, places, size = [], [], 0

    def flush() -> pa.RecordBatch:
        word, first, n = np.unique(np.concatenate(words), return_index=True, return_counts=True)
        return pa.record_batch({"word": pa.array(word.view(np.int64)), "bucket": pa.array(np.concatenate(places)[first].astype(np.int32)), "n": pa.array(n)})

    for b in batches:
        for _, _, data, offsets in groups(b):
            s, e, _ = FOLDED.spans(data, offsets)
            words.append(FOLDED.hashes(data, s, e))
            places.append(buckets(data, s, e).astype(np.int16))
            size += len(s)
            if size >= 3_000_000:
                yield flush()
                words, places, size = [], [], 0
    if size:
        yield flush()


class Vocabulary:
    """What tasks know of the words: the TABLE most frequent ones with counts, and the buckets."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, own: int, tokens: np.ndarray, kinds: np.ndarray):
        """words: from frequent to rare; tokens, kinds: of all words of each bucket without the own ones."""
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        self.classes = np.zeros(len(words), np.int64)  # 0: none of its own
        self.classes[rank[:own]] = np.arange(1, 1 + min(own, len(words)))
        self.own = min(own, len(words))
        self.tokens, self.kinds = tokens, kinds
        self.n_classes = 1 + self.own + BUCKETS

    def shares(self) -> np.ndarray:
        """log10 of the tokens and kinds of each bucket: what a word's count is divided by."""
        return np.log10(np.maximum(1, self.tokens + self.kinds))


def _encode(vocabulary: Vocabulary):
    """Of each document: classes, and what its words in the table add; the other words are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, shares = vocabulary, vocabulary.shares()
        log_n, log_n1 = np.log10(np.maximum(1, v.counts)), np.log10(v.counts + 1)
        for b in batches:
            for row, stop, data, offsets in groups(b):
                s, e, first = FOLDED.spans(data, offsets)
                h, bucket = FOLDED.hashes(data, s, e), buckets(data, s, e)
                at = np.minimum(np.searchsorted(v.words, h), max(0, len(v.words) - 1))
                known = v.words[at] == h if len(v.words) else np.zeros(len(h), np.bool_)
                mine = np.where(known, v.classes[at], 0) if len(v.words) else np.zeros(len(h), np.int64)
                rare = mine == 0
                total = lambda x: np.diff(np.concatenate(([0.0], np.cumsum(x)))[first]) if len(x) else np.zeros(len(first) - 1)
                plus = np.where(known, log_n1[at], 0.0) if len(v.words) else np.zeros(len(h))
                share = (np.where(known & rare, log_n[at], 0.0) if len(v.words) else 0.0) - np.where(rare, shares[bucket], 0.0)
                classes = np.where(rare, 1 + v.own + bucket, mine).astype("<u2")
                ends = np.insert(classes, first[1:], 0)  # each document's end
                edge = first + np.arange(len(first))
                rest = np.flatnonzero(~known)
                cut = np.searchsorted(rest, first)
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays([pa.array(h[rest].view(np.int64)), pa.array(bucket[rest].astype(np.int32))], ["word", "bucket"]))
                yield pa.record_batch({
                    "doc_id": b.column("doc_id").slice(row, stop - row), "held_out": b.column("held_out").slice(row, stop - row),
                    "n_tokens": pa.array(np.diff(edge)), "n_known": pa.array(total(known.astype(float)).round().astype(np.int64)),
                    "plus": pa.array(_sum_by(plus, first)), "share": pa.array(_sum_by(share, first)),
                    "classes": pa.array([ends[edge[i] : edge[i + 1]].tobytes() for i in range(len(first) - 1)], pa.binary()), "rest": lists,
                })

    return run


def _sum_by(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x over [first[i], first[i + 1]), each by itself."""
    out = np.zeros(len(first) - 1)
    some = np.flatnonzero(first[1:] > first[:-1])
    if len(some):
        out[some] = np.add.reduceat(x, first[some])
    return out


_ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, plus double, share double, classes binary, rest array<struct<word: long, bucket: int>>"


class Model:
    """start (K), move (K x K) and emit (classes x K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def guess(cls, share: np.ndarray, states: int, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        emit = share[:, None] * rng.uniform(0.5, 1.5, (len(share), states))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def fit(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Model:
        """From expected counts."""
        k = len(start)
        emit = emit + PRIOR * share[:, None]
        return cls((start + MOVES) / (start.sum() + MOVES * k), (move + MOVES) / (move.sum(1, keepdims=True) + MOVES * k), emit / emit.sum(0))


def _runs(lengths: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Indexes of sequences from long to short, in runs of about ``limit`` items and MOST sequences at most."""
    order = np.argsort(-lengths, kind="stable")
    sums = np.cumsum(lengths[order])
    at = 0
    while at < len(order):
        end = min(at + MOST, max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + limit, "right"))))
        yield order[at:end]
        at = end


class _Run:
    """Sequences from long to short side by side: ``items`` holds the first of each, then the second of each, and so on."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(x) for x in sequences])
        #: For each time step, how many of the sequences still run, and where its items start.
        self.active = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        self.edge = np.concatenate(([0], np.cumsum(self.active)))
        self.items = np.empty(self.edge[-1], sequences[0].dtype)
        at = 0
        while at < len(sequences):  # tables of sequences of about one length, turned over
            end = min(int(np.searchsorted(-lengths, -(lengths[at] // 2), "right")), at + max(1, (1 << 21) // int(lengths[at])))
            table = np.zeros((end - at, lengths[at]), sequences[at].dtype)
            for row, x in zip(table, sequences[at:end]):
                row[: len(x)] = x
            for t, (column, n) in enumerate(zip(np.ascontiguousarray(table.T), np.minimum(self.active[: lengths[at]], end) - at)):
                self.items[self.edge[t] + at : self.edge[t] + at + n] = column[:n]
            at = end


def _products(model: Model, pieces: list[np.ndarray], heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the chances (K x K) of its items and its last state, given the state before it, scaled, and the logarithm of the scale.

    heads: pieces that start a sequence, whose first state follows ``start``, whatever the row.
    """
    k, out, scales = len(model.start), np.empty((len(model.start),) * 2 + (len(pieces),)), np.empty(len(pieces))
    emit, move = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    lengths = np.array([len(x) for x in pieces], np.int64)
    for which, first in ((np.flatnonzero(heads), model.start[:, None, None]), (np.flatnonzero(~heads), move[:, :, None])):
        for mine in (which[x] for x in _runs(lengths[which], RUN // 16)):
            run = _Run([pieces[i] for i in mine])
            state, log = None, np.zeros(len(mine))
            for t, n in enumerate(run.active):
                now = emit[:, run.items[run.edge[t] : run.edge[t + 1]]]
                if state is None:  # state[j, i]: the state reached, from the state before, which for heads is all one
                    state = first * now[:, None, :]
                else:
                    if n < state.shape[2]:
                        out[:, :, mine[n : state.shape[2]]] = state[:, :, n:].transpose(1, 0, 2)
                        state = state[:, :, :n]
                    state = (move @ state.reshape(k, -1)).reshape(k, -1, n) * now[:, None, :]
                if t % RESCALE == 0:
                    most = state.max((0, 1))
                    state /= most
                    log[:n] += np.log(most)
            out[:, :, mine[: state.shape[2]]] = state.transpose(1, 0, 2)
            scales[mine] = log
    return out, scales


def _span(lengths: np.ndarray) -> int:
    """Items of a piece: as many as WIDE sequences have, but PIECE at least."""
    return max(PIECE, int(np.partition(lengths, -WIDE)[-WIDE])) if len(lengths) >= WIDE else PIECE


def _cut(sequences: list[np.ndarray], span: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Pieces of ``span`` items at most, in order, the sequence of each, and which of them start one."""
    pieces = [x[i : i + span] for x in sequences for i in range(0, len(x), span)]
    owner = np.repeat(np.arange(len(sequences)), np.array([-(-len(x) // span) for x in sequences], np.int64))
    return pieces, owner, np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.bool_)


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Natural logarithms of the probabilities of class sequences, by the scaled forward recursion.

    A sequence of more items than a piece has goes piece by piece as products of
    matrices, which is the same recursion in another order of multiplication.
    """
    out, emit, move = np.zeros(len(sequences)), np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    lengths = np.array([len(s) for s in sequences], np.int64)
    span = _span(lengths)
    short = np.flatnonzero(lengths <= span)
    for mine in _runs(lengths[short], RUN // 8):
        run = _Run([sequences[i] for i in short[mine]])
        score, state = np.zeros(len(mine)), None
        for t, n in enumerate(run.active):
            now = emit[:, run.items[run.edge[t] : run.edge[t + 1]]]
            state = now * (model.start[:, None] if state is None else move @ state[:, :n])
            scale = state.sum(0)
            state /= scale
            score[:n] += np.log(scale)
        out[short[mine]] = score
    long = np.flatnonzero(lengths > span)
    if len(long):
        pieces, owner, heads = _cut([sequences[i] for i in long], span)
        steps, scales = _products(model, pieces, heads)
        for p, i in enumerate(owner):
            row = (np.eye(1, len(model.start))[0] if heads[p] else row) @ steps[:, :, p]  # noqa: F821
            total = row.sum()
            row = row / total
            out[long[i]] += np.log(total) + scales[p]
    return out


class _Chances:
    """Adds the chances of states at items to the counts of classes (k x classes), many items at a time."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.items, self.held, self.size = counts, np.empty(HELD, np.int64), np.empty((len(counts), HELD)), 0

    def add(self, items: np.ndarray, chances: np.ndarray) -> None:
        for a in range(0, len(items), HELD):
            n = min(HELD, len(items) - a)
            if self.size + n > HELD:
                self.flush()
            at = slice(self.size, self.size + n)
            self.items[at], self.held[:, at] = items[a : a + n], chances[:, a : a + n]
            self.size += n

    def flush(self) -> None:
        for row, held in zip(self.counts, self.held):
            row += np.bincount(self.items[: self.size], held[: self.size], len(row))
        self.size = 0


def expect(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions (one Baum-Welch step).

    The pieces of a long sequence run side by side, each from the exact
    forward numbers at its start and with the exact backward numbers at its
    end, which products over pieces give; so cutting changes no count. In time
    they go window by window: one pass keeps the forward numbers at which each
    window starts, and the windows, the last one first, hand the backward
    numbers on.
    """
    k, c = len(model.start), len(model.emit)
    start, moved, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((k, c))
    pieces, owner, heads = _cut(sequences, _span(np.array([len(x) for x in sequences], np.int64)))
    before, after = np.ones((k, len(pieces))), np.ones((k, len(pieces)))  # forward numbers before a piece, backward ones at its end
    tails = np.concatenate((heads[1:], [True])) if len(heads) else heads
    part = np.flatnonzero(~(heads & tails))  # pieces of longer sequences
    if len(part):
        steps, _ = _products(model, [pieces[i] for i in part], heads[part])
        for at, p in enumerate(part):
            row = (np.eye(1, k)[0] if heads[p] else before[:, p]) @ steps[:, :, at]
            if not tails[p]:
                before[:, p + 1] = row / row.sum()
        for at, p in reversed(list(enumerate(part))):
            if not heads[p]:
                column = steps[:, :, at] @ after[:, p]
                after[:, p - 1] = column / column.sum()
    emit, move = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    chances = _Chances(emitted)
    for mine in _runs(np.array([len(x) for x in pieces], np.int64), RUN):
        run = _Run([pieces[i] for i in mine])
        edge, active, head = run.edge.tolist(), run.active.tolist(), heads[mine]
        first = np.where(head, model.start[:, None], move @ before[:, mine])
        times = [0]
        while times[-1] < len(active):
            times.append(max(times[-1] + 1, int(np.searchsorted(run.edge, edge[times[-1]] + BATCH, "right")) - 1))
        room = np.empty((3, k * max(edge[z] - edge[a] for a, z in zip(times, times[1:]))))
        held = np.empty((k, len(mine)))

        def ahead(lo: int, hi: int, enter: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Chances of the items of a window, forward numbers, and by what each was scaled; enter: the numbers before it."""
            base, size = edge[lo], edge[hi] - edge[lo]  # noqa: B023
            seen, alpha = room[:2, : k * size].reshape(2, k, size)  # noqa: B023
            np.take(emit, run.items[base : base + size].astype(np.intp), axis=1, out=seen, mode="clip")  # noqa: B023
            shrunk, old = np.ones(size), enter
            for t in range(lo, hi):
                a, z = edge[t] - base, edge[t + 1] - base  # noqa: B023
                now = first if old is None else np.matmul(move, old[:, : z - a], out=held[:, : z - a])  # noqa: B023
                if t % RESCALE == 0 and t:  # any scale does: what is counted is normalised at each item
                    by = 1 / now.sum(0)
                    now *= by
                    shrunk[a:z] = by
                old = np.multiply(seen[:, a:z], now, out=alpha[:, a:z])
            return seen, alpha, shrunk

        enters: list[np.ndarray | None] = [None]
        for lo, hi in zip(times, times[1:-1]):
            _, alpha, _ = ahead(lo, hi, enters[-1])
            a = edge[hi - 1] - edge[lo]
            enters.append(alpha[:, a : a + active[hi]].copy())
        last, back = after[:, mine], held[:, :0]  # back: backward numbers of the sequences that go on behind the window
        for lo, hi, enter in zip(times[-2::-1], times[:0:-1], reversed(enters)):
            seen, alpha, shrunk = ahead(lo, hi, enter)
            base, beta = edge[lo], room[2, : seen.size].reshape(seen.shape)
            for t in range(hi - 1, lo - 1, -1):
                a, b, n = edge[t] - base, edge[t + 1] - base, active[t]
                later = active[t + 1] if t + 1 < len(active) else 0
                if t == hi - 1:
                    beta[:, a : a + later] = back
                else:
                    now = np.multiply(seen[:, b : b + later], beta[:, b : b + later], out=held[:, :later])
                    if t % RESCALE == 0:
                        now /= now.sum(0)
                    np.matmul(model.move, now, out=beta[:, a : a + later])
                if later < n:
                    beta[:, a + later : b] = last[:, later:n]
            seen *= beta
            n = active[lo]
            back = model.move @ (seen[:, :n] / seen[:, :n].sum(0))
            beta *= alpha
            total = beta.sum(0)
            beta /= total
            chances.add(run.items[base : edge[hi]], beta)
            seen *= np.divide(shrunk, total, out=shrunk)
            if enter is not None:
                moved += enter @ seen[:, :n].T
            else:
                start += beta[:, :n][:, head].sum(1)
                moved += before[:, mine[~head]] @ seen[:, :n][:, ~head].T
            t = lo + 1
            while t < hi:  # time steps of as many sequences as the step before have lie side by side
                z = t + 1
                while z < hi and active[z] == active[z - 1] == active[t - 1]:
                    z += 1
                size = edge[z] - edge[t]
                moved += alpha[:, edge[t - 1] - base : edge[t - 1] - base + size] @ seen[:, edge[t] - base : edge[z] - base].T
                t = z
    chances.flush()
    return start, model.move * moved, emitted.T


def _sequences(classes: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2") for x in classes]


def _expect(model: Model):
    """Expected counts of a task, in rows by class; class -1 has the starts, -2 - i the moves from state i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.start)
        start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit)
        held, size = [], 0

        def count() -> None:
            for all_, x in zip((start, move, emit), expect(model, held)):
                all_ += x

        for b in batches:
            held += _sequences(b.column("classes"))
            size += b.column("classes").nbytes // 2
            if size >= RUN:  # short batches side by side
                count()
                held, size = [], 0
        count()
        some = np.flatnonzero(emit.any(1))
        rows = np.concatenate((start[None], move, emit[some]))
        names = np.concatenate(([-1], -2 - np.arange(k), some))
        yield pa.record_batch({"class": pa.array(names)} | {f"s{j}": pa.array(rows[:, j]) for j in range(k)})

    return run


def _round(model: Model, training: DataFrame, share: np.ndarray) -> Model:
    k = len(model.start)
    rows = training.mapInArrow(_expect(model), "class long, " + ", ".join(f"s{j} double" for j in range(k)))
    sums = rows.groupBy("class").agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(k))).toArrow()  # one row for each class at most
    names, values = sums.column(0).to_numpy(), np.stack([sums.column(1 + j).to_numpy() for j in range(k)], 1)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit)
    for name, row in zip(names[names < 0].tolist(), values[names < 0], strict=True):
        if name == -1:
            start = row
        else:
            move[-2 - name] = row
    emit[names[names >= 0]] = values[names >= 0]
    return Model.fit(start, move, emit, share)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = forward(model, _sequences(b.column("classes"))) / math.log(10)
            yield pa.record_batch({"row": b.column("row"), "classes_score": pa.array(got)})

    return run


def score(docs: DataFrame, *, states: int = STATES, own: int = OWN, table: int = TABLE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    common.ship(spark)
    scratch = common.Scratch(spark, "hmm")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = common.texts(docs).withColumn("held_out", held)
    training = docs.filter("not held_out")
    counts = scratch.write(training.select("text").mapInArrow(_tally, "word long, bucket int, n long").groupBy("word").agg(F.min("bucket").alias("bucket"), F.sum("n").alias("n")), "counts")
    ends = training.count()
    kinds, tokens = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    train_tokens, train_kinds = tokens + ends, kinds + (ends > 0)
    top = common.most_frequent(counts, "n", table).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    own = min(own, int((top.column("n").to_numpy() >= OWN_LEAST).sum()))
    by_bucket = counts.groupBy("bucket").agg(F.sum("n").alias("tokens"), F.count("*").alias("kinds")).collect()  # BUCKETS rows at most
    bucket_tokens, bucket_kinds = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in by_bucket:
        bucket_tokens[r.bucket], bucket_kinds[r.bucket] = r.tokens, r.kinds
    own_n, own_bucket = top.column("n").to_numpy()[:own], top.column("bucket").to_numpy()[:own]
    bucket_tokens -= np.bincount(own_bucket, own_n, BUCKETS).astype(np.int64)
    bucket_kinds -= np.bincount(own_bucket, minlength=BUCKETS)
    vocabulary = Vocabulary(top.column("word").to_numpy().view(U), top.column("n").to_numpy(), own, bucket_tokens, bucket_kinds)
    share = np.concatenate(([ends], own_n, bucket_tokens)).astype(float) + 1
    share /= share.sum()
    encoded = scratch.write(docs.mapInArrow(_encode(vocabulary), _ENCODED).withColumn("row", F.monotonically_increasing_id()), "encoded")
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-train_tokens // TASK_TOKENS))
    learning = encoded.filter("not held_out").select("classes").coalesce(tasks)
    model = Model.guess(share, states)
    for _ in range(rounds if ends else 0):
        model = _round(model, learning, share)
    rest = encoded.select("row", F.explode("rest").alias("w")).select("row", "w.word", "w.bucket")
    unknown = spark.createDataFrame([(i, float(math.log10(max(1, int(n))))) for i, n in enumerate(bucket_kinds)], "bucket int, unknown double")
    rest = rest.join(counts.select("word", "n"), "word", "left").join(F.broadcast(unknown), "bucket")
    rest = rest.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("rest_plus"),
        F.sum(F.when(F.col("n").isNull(), F.col("unknown")).otherwise(F.log10("n"))).alias("rest_share"),
        F.count("n").alias("rest_known"),
    )
    scored = encoded.select("row", "classes").mapInArrow(_score(model), "row long, classes_score double")
    all_ = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "plus", "share").join(scored, "row").join(rest, "row", "left")
    zero, end = F.lit(0.0), math.log10(ends + 1)
    return all_.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rest_known", F.lit(0)) + (1 if ends else 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("plus") + F.coalesce("rest_plus", zero) + end - F.col("n_tokens") * math.log10(train_tokens + train_kinds + 1)).alias("base_score"),
        (F.col("classes_score") + F.col("share") + F.coalesce("rest_share", zero)).alias("score"),
    )
