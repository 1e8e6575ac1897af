"""Vectorised text kernels over UTF-8 buffers.

Texts of an Arrow column are handled as one byte buffer with row offsets;
words are maximal runs of bytes other than space and 0x09-0x0D. Batches are
cut into slices of bounded bytes, so memory doesn't follow the batch size
(one text longer than a slice is a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(int(_P), -1, 1 << 64))
_Q = U64(0xD1342543DE82EF95)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U64) * _P)
_FOLDED = _BYTE.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least ``n`` of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        made = []
        for base in (_P, _P_INV):
            p = np.full(size, base, U64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=U64))
        if size > 8 * SLICE_BYTES:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    buffers = column.buffers()
    off = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` with at most ``most`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(column))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


class Words(NamedTuple):
    """Byte ranges of the words of a slice; ``first[i]`` is the first word of row i."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def words(data: np.ndarray, off: np.ndarray) -> Words:
    inside = ~_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    rows = off[:-1][off[:-1] < off[1:]]
    begin[rows] = inside[rows]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    last = rows[1:] - 1
    finish[last] = inside[last]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, off))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes (A-Z folded if asked) hash alike."""
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * power[: len(data)], out=sums[1:], dtype=U64)
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U64))


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, their start words, and row offsets into them."""
    n = len(hashes)
    counts = np.diff(first)
    each = np.maximum(counts - k + 1, 0)
    rows = np.concatenate([[0], np.cumsum(each)])
    if n < k or not rows[-1]:
        return np.zeros(0, U64), np.zeros(0, np.int64), rows
    total = hashes[: n - k + 1].copy()
    q = U64(1)
    for j in range(1, k):
        q = U64((int(q) * int(_Q)) & 0xFFFFFFFFFFFFFFFF)
        total += hashes[j : n - k + 1 + j] * q
    keep = np.arange(rows[-1]) + np.repeat(first[:-1] - rows[:-1], each)
    return mix64(total[keep]), keep, rows


def by_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between row offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[rows[1:]] - total[rows[:-1]]


def row_of(rows: np.ndarray) -> np.ndarray:
    """The row of each element, from row offsets."""
    return np.repeat(np.arange(len(rows) - 1), np.diff(rows))


def distinct_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the sorted distinct hashes of its ``k``-word shingles.

    A-Z are folded. A row of fewer than ``k`` words has its whole sequence as
    its one shingle, a row without words none. Returns hashes and row offsets.
    """
    w = words(data, off)
    h = range_hashes(data, w.starts, w.ends, fold=True)
    found, _, rows = windows(h, w.first, k)
    counts = np.diff(w.first)
    short = np.flatnonzero((counts > 0) & (counts < k))
    row = row_of(rows)
    if len(short):
        extra = np.zeros(len(short), U64)
        for n in range(1, k):
            of = short[counts[short] == n]
            if len(of):
                total = np.zeros(len(of), U64)
                q = U64(1)
                for j in range(n):
                    total += h[w.first[of] + j] * q
                    q = U64((int(q) * int(_Q)) & 0xFFFFFFFFFFFFFFFF)
                extra[counts[short] == n] = mix64(total + U64(n))
        found, row = np.concatenate([found, extra]), np.concatenate([row, short])
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    found, row = found[fresh], row[fresh]
    return found, np.searchsorted(row, np.arange(len(off)))
