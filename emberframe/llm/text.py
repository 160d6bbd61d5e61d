"""Vectorised helpers over Arrow batches of texts: words, word hashes, shingles.

All functions work on UTF-8 bytes. A word is a maximal run of bytes other than space and tab to
carriage return. Hashes have 64 bits; two different shingles of a pair of texts agree with a
probability of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
SHINGLE_WORDS = 5

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Slices of rows with about ``limit`` bytes of text each: (rows, bytes, offsets)."""
    data, offsets = _bytes_of(batch.column(text))
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield slice(first, last), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, first and end byte of every word of a chunk."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    solid = ~_WHITE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _STEP)
    return hashed, np.searchsorted(offsets, start, side="right") - 1, start, end


def shingles(hashed: np.ndarray, row: np.ndarray, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every run of ``width`` words; a shorter text is one shingle."""
    n = len(hashed)
    if not n:
        return hashed, row, row
    out = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        out = out * _STEP + hashed[k : k + len(out)]
    first = np.flatnonzero(row[: len(out)] == row[width - 1 :]) if len(out) else np.zeros(0, np.int64)
    value, where = mix(out[first]), row[first]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    lengths = np.diff(np.r_[starts, n])
    short = np.flatnonzero(lengths < width)
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            more = lengths[short] > k
            extra = np.where(more, extra * _STEP + hashed[np.minimum(starts[short] + k, n - 1)], extra)
        extra = mix(extra ^ (lengths[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        value, where, first = np.r_[value, extra], np.r_[where, row[starts[short]]], np.r_[first, starts[short]]
        order = np.argsort(first, kind="stable")
        value, where, first = value[order], where[order], first[order]
    return value, where, first
