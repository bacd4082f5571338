"""Arrow string columns as byte arrays: words, their hashes and byte counts, without a loop over rows.

A batch is handled in slices of about ``SLICE`` bytes (one text at least), so the
working arrays stay small whatever the batch holds.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1_000_000
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def give_back() -> None:
    """Free memory goes back to the system, as far as the platform can: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: A 64-bit value for each byte; white space counts nothing.
BYTE = np.where(IS_SPACE, np.uint64(0), mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C55)


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 ... base**(n-1), modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows; offsets start at 0 and end at the bytes' length; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    n = len(column)
    if not n:
        return
    off = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the offsets of each text in that list."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = IS_SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[off] = True
    before = np.concatenate([[True], space[:-1]]) | border[:-1]
    after = np.concatenate([space[1:], [True]]) | border[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    gap = np.diff(np.concatenate([starts, [len(data)]]))
    body = data[starts[0] :]
    at = np.arange(len(body), dtype=np.int64) - np.repeat(starts - starts[0], gap)
    table = powers(int(gap.max()))
    value = BYTE[body]
    value *= table[at]
    return mix64(np.add.reduceat(value, starts - starts[0]) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


def grams(h: np.ndarray, n: int, base: int = 0xA24BAED4963EE407) -> np.ndarray:
    """A hash of each run of n word hashes, for all starts 0 .. len(h) - n (texts' borders not looked at)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out, p = np.zeros(m, np.uint64), 1
    for k in range(n):
        out += h[k : k + m] * np.uint64(p)
        p = p * base % (1 << 64)
    return mix64(out)
