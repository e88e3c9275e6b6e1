"""Array kernels that the text operators share: Arrow strings as bytes, words, hashes.

All work is on whole texts. A batch is cut into chunks of whole rows, so that the arrays of one chunk stay small; a row
longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Yield (first row, row after the last, bytes, offsets of the rows in them); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = memoryview(data) if data is not None else memoryview(b"")
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, bytes(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
        i = j


def byte_words(data: bytes, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes for which the table `word` holds, none across rows.

    Returns the bytes, the runs' starts and ends, and for each row the index of its first run (one entry more at the end).
    """
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = word[raw]
    now = inside[1:-1]
    before, after = inside[:-2].copy(), inside[2:].copy()
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(now & ~before), np.flatnonzero(now & ~after) + 1
    return raw, starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: equal bits stay equal, near values part."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK + 1, n + 1)
    if size not in _POWERS:
        pair = powers(_BASE, size), powers(_INVERSE, size)
        if size > CHUNK + 1:  # a very long text: not kept
            return pair
        _POWERS[size] = pair
    return _POWERS[size]


def slice_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte slices: differences of one running polynomial, brought back to power 0, then mixed."""
    up, down = _tables(len(raw))
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive word hashes (rows are not told apart here)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    q = powers(0xD6E8FEB86659FD93, k)
    out = np.zeros(n, U64)
    for j in range(k):
        out += words[j : j + n] * q[j]
    return mix(out)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w consecutive hashes, the place of its rightmost minimum."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, have = h.copy(), np.arange(len(h)), 1
    # doubling: after each step best[i] is the minimum of h[i : i + have]
    while have < w:
        step = min(have, w - have)
        m = len(best) - step
        left, right = best[:m], best[step : step + m]
        take = right <= left
        best, at, have = np.where(take, right, left), np.where(take, at[step : step + m], at[:m]), have + step
    return at[:n]


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    i = np.searchsorted(table, values)
    i[i == len(table)] = 0
    return table[i] == values


def repeats(counts: np.ndarray) -> np.ndarray:
    """The row of each element, if row i has counts[i] elements."""
    return np.repeat(np.arange(len(counts)), counts)
