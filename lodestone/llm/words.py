"""Words and word n-grams of whole texts, as arrays.

A word is a run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text. All
functions work on the value buffer of an Arrow string column, many rows at a
time. 64-bit hashes stand for words and n-grams; they depend on nothing but the
bytes, so every task and every run computes the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RADIX = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RADIX, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(256, dtype=np.uint64))
_BYTES_LOWER = _BYTES.copy()
_BYTES_LOWER[65:91] = _BYTES[97:123]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _powers:
        if size > 2 * SLICE_BYTES:  # a single enormous word: not worth keeping
            return _radix_powers(_RADIX, size), _radix_powers(_INVERSE, size)
        _powers.clear()
        _powers[size] = _radix_powers(_RADIX, size), _radix_powers(_INVERSE, size)
    return _powers[size]


def _radix_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) for runs of rows of about `limit` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _spans(buf: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; firsts: where rows begin, so that no word goes across."""
    inside = ~_SPACE[buf]
    cut = np.ones(len(buf) + 1, bool)
    cut[1:-1] = ~inside[:-1]
    cut[firsts] = True
    starts = np.flatnonzero(inside & cut[:-1])
    cut[:-1] = ~inside
    cut[-1] = True
    cut[firsts] = True
    return starts, np.flatnonzero(inside & cut[1:]) + 1


def _hash_block(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    power, inverse = _power_tables(max(2, len(buf)))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * power[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, spans: bool = False):
    """(hash of each word, row of each word) or, with spans, (hashes, rows, starts, ends).

    Blocks of a few MB are cut at white space, so that a very long text needs
    memory for its words, not several times for its bytes.
    """
    table, n, at = _BYTES_LOWER if lower else _BYTES, len(buf), 0
    hashes, starts, ends = [], [], []
    while at < n:
        end = min(n, at + SLICE_BYTES)
        if end < n:
            space = np.flatnonzero(_SPACE[buf[max(at, end - 65536) : end]])
            if len(space):
                end = max(at, end - 65536) + int(space[-1]) + 1
            else:
                space = np.flatnonzero(_SPACE[buf[end:]])
                end = end + int(space[0]) + 1 if len(space) else n
        block = buf[at:end]
        firsts = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        s, e = _spans(block, firsts)
        hashes.append(_hash_block(block, s, e, table))
        starts.append(s + at)
        if spans:
            ends.append(e + at)
        at = end
    none = np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else none
    rows = np.searchsorted(offsets, s, "right") - 1
    return (h, rows, s, np.concatenate(ends) if ends else none) if spans else (h, rows)


def ngrams(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of each run of k words of one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = hashes[:n].copy()
    for j in range(1, k):
        acc *= _STEP
        acc += hashes[j : j + n]
    first = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix(acc[first] + np.uint64(k)), first


def row_firsts(rows: np.ndarray, n: int) -> np.ndarray:
    """Index of the first word of each row, and of the end: n + 1 numbers."""
    return np.searchsorted(rows, np.arange(n + 1))
