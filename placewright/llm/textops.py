"""Vectorised text helpers used inside tasks: words, word hashes, shingles.

All functions work on one bounded slice of an Arrow string column at a time, so
a task's memory follows the slice (``SLICE_BYTES`` or one long text), not the
partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = [np.ones(1, U), np.ones(1, U)]


def table(separators: bytes) -> np.ndarray:
    """True for the byte values that separate words."""
    t = np.zeros(256, bool)
    t[np.frombuffer(separators, np.uint8)] = True
    return t


#: Words ``[^\x20\x09-\x0D]+``.
SPACE = table(b" \t\n\v\f\r")
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text.
NOT_ALNUM = table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        for i, b in enumerate((_BASE, inverse)):
            steps = np.full(n, b, U)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) with at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = strings(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            i = j


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text its first word (one entry more than texts)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~separators[LOWER[data]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def prefix_hashes(data: np.ndarray, lower: bool = True) -> np.ndarray:
    """Polynomial hash of every prefix, modulo 2**64."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[LOWER[data] if lower else data] * p[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of bytes, the same wherever the bytes stand."""
    _, inverse = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(U))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_hashes(data), starts, ends)


def shingles(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``size`` words; a text of fewer words, but not none, gives its whole sequence."""
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    total = len(hashes)
    if total >= size:
        mixed = np.zeros(total - size + 1, U)
        for k in range(size):
            mixed += hashes[k : total - size + 1 + k] * U(pow(_BASE, k + 1, 1 << 64))
        whole = text[: total - size + 1] == text[size - 1 :]
        owner, value = text[: total - size + 1][whole], mix(mixed[whole])
    else:
        owner, value = np.zeros(0, np.int64), np.zeros(0, U)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        sums = np.zeros(len(short), U)
        for k in range(size - 1):
            has = counts[short] > k
            sums[has] += hashes[first[short[has]] + k] * U(pow(_BASE, k + 1, 1 << 64))
        owner = np.concatenate([owner, short])
        value = np.concatenate([value, mix(sums + counts[short].astype(U))])
        order = np.argsort(owner, kind="stable")
        owner, value = owner[order], value[order]
    return owner, value


def distinct(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (owner, value) pairs."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def longs(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def fixed_rows(x: np.ndarray) -> pa.Array:
    """One binary value per row of a two-dimensional array."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.dtype.itemsize
    offsets = pa.py_buffer(np.arange(0, (len(x) + 1) * width, width, dtype=np.int32) if width else np.zeros(len(x) + 1, np.int32))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(x)])
