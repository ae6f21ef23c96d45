"""Vectorised byte-level text primitives shared by the corpus operators.

Everything works on the flat UTF-8 buffer of an Arrow string column, in slices
of bounded size, so a kernel's memory does not depend on the batch it is given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(256, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base; the table grows as longer words appear."""
    global _POWERS
    if len(_POWERS) < n or _POWERS[1] == 1:
        _POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 4096), _BASE)]))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most that many bytes; a longer row comes alone and whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = j


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each slice. Arrow's unused memory goes back to the system: workers outlive their tasks."""
    data, offsets = flat(column)
    for i, j in slices(offsets, most):
        o = offsets[i : j + 1]
        yield i, j, data[o[0] : o[-1]], o - o[0]
    del data, offsets
    pa.default_memory_pool().release_unused()


def lower(b: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in small letters, byte for byte."""
    out = _LOWER[b]
    lead = np.flatnonzero(b[:-1] == 0xC3) + 1
    up = lead[(b[lead] >= 0x80) & (b[lead] <= 0x9E) & (b[lead] != 0x97)]
    out[up] += 32
    return out


def spans(b: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first span of each row and the total): maximal runs of bytes that are no separators; none crosses a row."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[b]
    cut = np.zeros(len(b) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(b), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(b), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(b)
    p = powers(int((ends - starts).max()) + 1)
    place = np.arange(n, dtype=np.int64) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [n]])))
    np.minimum(place, len(p) - 1, out=place)
    x = np.zeros(n + 1, np.uint64)
    np.multiply(_BYTE[b], p[place], out=x[:n])
    at = np.empty(2 * len(starts), np.int64)
    at[::2], at[1::2] = starts, ends
    return mix(np.add.reduceat(x, at)[::2] + (ends - starts).astype(np.uint64))


def prefix_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size, the hash of so many first bytes of each span, as hashes() gives it; 0 of shorter spans."""
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in sizes]
    p = powers(max(sizes) + 1)
    total, out = np.zeros(len(starts), np.uint64), []
    for k in range(max(sizes)):
        total = total + _BYTE[b[np.minimum(starts + k, len(b) - 1)]] * p[k]
        if k + 1 in sizes:
            out.append(np.where(ends - starts > k, mix(total + np.uint64(k + 1)), np.uint64(0)))
    return out


def ws_words(b: np.ndarray, offsets: np.ndarray):
    """White-space separated words: (hashes, starts, ends, row offsets)."""
    s, e, rows = spans(b, offsets, _SPACE)
    return hashes(b, s, e), s, e, rows


def lower_words(b: np.ndarray, offsets: np.ndarray):
    """Runs of letters and digits, in small letters: (hashes, starts, ends, row offsets)."""
    s, e, rows = spans(b, offsets, ~_LETTER)
    return hashes(lower(b), s, e), s, e, rows


def word_hash(word: str) -> int:
    """The hash that lower_words gives to that word."""
    b = np.frombuffer(word.lower().encode(), np.uint8)
    return int(hashes(b, np.array([0]), np.array([len(b)]))[0])


def row_sums(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; rows: offsets as spans() gives them. Empty rows sum to 0."""
    total = np.concatenate([np.zeros(1, np.result_type(values.dtype, np.float64 if values.dtype.kind == "f" else np.int64)), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[rows[1:]] - total[rows[:-1]]


def ragged(flat_values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column of those values, so many in each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat_values, kind))
