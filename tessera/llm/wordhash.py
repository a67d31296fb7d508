"""Words of many texts as 64-bit hashes, by array operations over the raw bytes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes hashed at once, which bounds the 8-byte work arrays.
SEGMENT = 1 << 19
#: Bytes of text whose words are held at once, unless one text is longer.
GROUP = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


@lru_cache(None)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        steps = np.full(SEGMENT + 1, base & (2**64 - 1), U)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return run(_BASE), run(pow(_BASE, -1, 2**64))


class Words:
    """A way to cut bytes into words: separators as a set of byte values; lower folds A-Z."""

    def __init__(self, separators: bytes, lower: bool):
        self.is_word = np.ones(256, np.bool_)
        self.is_word[list(separators)] = False
        values = np.arange(256, dtype=U)
        if lower:
            values[65:91] += U(32)
        self.table = mix((values + U(1)) * _STEP)

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words, and for each text the index of its first word (and the end)."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        inside = self.is_word[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One 64-bit hash for each word, a function of its (folded) bytes alone."""
        out = np.empty(len(starts), U)
        i = 0
        while i < len(starts):
            base = int(starts[i])
            j = int(np.searchsorted(ends, base + SEGMENT, "right"))
            if j <= i:  # one word longer than a segment
                out[i] = self._long(data[base : ends[i]])
                i += 1
                continue
            up, down = _powers()
            part = self.table[data[base : ends[j - 1]]]
            part *= up[: len(part)]
            total = np.zeros(len(part) + 1, U)
            np.cumsum(part, out=total[1:])
            s, e = starts[i:j] - base, ends[i:j] - base
            out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
            i = j
        return out

    def _long(self, data: np.ndarray) -> int:
        up, _ = _powers()
        total, scale, n = 0, 1, len(data)
        for at in range(0, n, SEGMENT):
            part = self.table[data[at : at + SEGMENT]]
            part *= up[: len(part)]
            total += int(part.sum(dtype=U)) * scale
            scale = scale * pow(_BASE, len(part), 2**64) % 2**64
        return int(mix(np.array([(total + n) % 2**64], U))[0])


ASCII_SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Words between ASCII white space, as they are and with A-Z folded.
PLAIN = Words(ASCII_SPACE, lower=False)
FOLDED = Words(ASCII_SPACE, lower=True)
#: Folded words of letters, digits and all that is not ASCII.
ALNUM = Words(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 words start none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out *= _STEP
        out += hashes[j : j + n]
    return mix(out + U(k))


def gram_starts(first: np.ndarray, k: int) -> np.ndarray:
    """True for each word of a group at which k words of one text start; first as spans() has it."""
    n = int(first[-1])
    ok = np.ones(max(0, n), np.bool_)
    for j in range(1, k):
        at = first[1:] - j
        ok[at[at >= first[:-1]]] = False
    return ok


def groups(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) for runs of rows of about GROUP bytes."""
    col = batch.column(column)
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1 + col.offset)[col.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP, "right")) - 1)
        end = min(end, n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
