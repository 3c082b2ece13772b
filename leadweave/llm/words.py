"""Words of whole texts as arrays of 64-bit hashes, an Arrow batch at a time."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_STEP, _INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WINDOW = U(0xD1342543DE82EF95)
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: what each byte counts in the second hash of a word
_VALUES = mix(np.arange(1, 257, dtype=U) * _WINDOW)


def release() -> None:
    """Give back what earlier tasks of this worker took: the power tables, and memory that is free but held."""
    _powers[:] = [np.ones(1, U), np.ones(1, U)]
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_STEP, _INVERSE)):
            a = np.full(n + n // 4, base, U)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the texts of each hold about max_bytes (one text at least)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(False)
        ends, begin = np.cumsum(size), 0
        while begin < batch.num_rows:
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + max_bytes, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


class Words:
    """Words of each text of an Arrow string array; a null has none.

    ``at`` holds the offsets of each text's words; ``start`` and ``end`` are places in ``data``.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, separators: np.ndarray = BLANKS):
        texts = pc.fill_null(pc.cast(texts, pa.large_string()), "")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[bounds[0]:bounds[-1]] if raw and len(bounds) else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        self.original, self.data = data, LOWER[data] if lower else data
        inside = ~separators[data]
        before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
        after = np.concatenate([inside[1:], [False]]) if len(data) else inside
        first, last = bounds[:-1][bounds[1:] > bounds[:-1]], bounds[1:][bounds[1:] > bounds[:-1]] - 1
        before[first] = False
        after[last] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.at = np.searchsorted(self.start, bounds)
        self.bounds = bounds

    def hashes(self, again: bool = False) -> np.ndarray:
        """A hash of each word's bytes; ``again`` gives one that is independent of the first."""
        n = len(self.data)
        up, down = _power_tables(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum((_VALUES[self.data] if again else self.data.astype(U) + U(1)) * up[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U))

    def split_between(self, kinds: np.ndarray) -> None:
        """Cut words wherever a byte of kind 1 stands beside one of kind 2."""
        kind = kinds[self.data]
        cut = np.flatnonzero(kind[:-1] * kind[1:] == 2) + 1
        edges = []
        for own in (self.start, self.end):
            mark = np.zeros(len(self.data) + 1, bool)
            mark[own] = mark[cut] = True
            edges.append(np.flatnonzero(mark))
        self.start, self.end = edges
        self.at = np.searchsorted(self.start, self.bounds)

    def text(self, k: int) -> bytes:
        return self.data[self.start[k]:self.end[k]].tobytes()


def _times(a: np.uint64, b: np.uint64) -> np.uint64:
    return U(int(a) * int(b) & 0xFFFFFFFFFFFFFFFF)


def windows(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n words from each place on, by doubling: places n, 2n, ... of one length from the one before."""
    out, length, done = np.zeros(0, U), 0, h + U(salt)
    width, factor = 1, _WINDOW
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    acc, acc_len, acc_pow = None, 0, U(1)
    while True:
        if n & width:
            if acc is None:
                acc, acc_len, acc_pow = done, width, factor
            else:
                k = len(h) - acc_len - width + 1
                acc, acc_len, acc_pow = acc[:k] + acc_pow * done[acc_len:acc_len + k], acc_len + width, _times(acc_pow, factor)
        width *= 2
        if width > n:
            break
        k = len(h) - width + 1
        done = done[:k] + factor * done[width // 2:width // 2 + k]
        factor = _times(factor, factor)
    return mix(acc[:m])


def window_starts(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts with words at[i]..at[i+1]: the places of all windows of n words, and the text of each."""
    count = np.maximum(at[1:] - at[:-1] - n + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    begin = np.concatenate([[0], np.cumsum(count)])
    return at[:-1][doc] + (np.arange(len(doc)) - begin[:-1][doc]), doc


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
