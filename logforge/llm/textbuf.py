"""Vectorised access to the UTF-8 buffers of Arrow string columns.

Every helper works on whole texts.  ``slices`` cuts a record batch into runs of
rows of about ``max_bytes`` of text, so that the 8-byte work arrays of numpy
stay small; a single longer text makes a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the polynomial hash, and its inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)

#: White space of the word rule: \x20 and \x09 to \x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a uint64 over all others."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size == 1 << 20:
            _powers[name] = have
    return have[:n]


def filled(column: pa.Array) -> pa.Array:
    """The column as plain strings, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    return column


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the offsets of each text in them."""
    column = filled(column)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Runs of consecutive rows holding about ``max_bytes`` of ``column``."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(sizes) - 1) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the number of words of each text."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at) - 1, np.int64)
    inside = ~_SPACE[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first = np.zeros(len(raw) + 1, bool)
    last = np.zeros(len(raw) + 1, bool)
    first[edge[inside[edge]]] = True
    last[edge[~inside[edge]]] = True
    first[0] |= inside[0]
    last[len(raw)] |= inside[-1]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    cut = cut[inside[cut] & inside[cut - 1]]  # two texts meet without white space
    first[cut] = True
    last[cut] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    return start, end, np.diff(np.searchsorted(start, at))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal spans have equal hashes anywhere."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power("up", _BASE, len(raw)), out=total[1:])
    return mix((total[end] - total[start]) * _power("down", _INVERSE, len(raw) + 1)[start] + (end - start).astype(np.uint64))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and the number of words of each text."""
    raw, at = buffer(column)
    start, end, counts = words(raw, at)
    return span_hashes(raw, start, end), counts


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words of each text; a text of fewer words, but one at least, has one shingle of them all."""
    number = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    starts = np.cumsum(counts) - counts
    out_start = np.cumsum(number) - number
    first = np.repeat(starts - out_start, number) + np.arange(number.sum())
    width = np.repeat(np.minimum(counts, n), number)
    total = np.zeros(len(first), np.uint64)
    for k in range(n):
        live = width > k
        part = hashes[np.minimum(first + k, max(len(hashes) - 1, 0))] if len(hashes) else total
        total = np.where(live, mix(total * _BASE + part), total)
    return total, number


def unique_by_row(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row, ascending, and their number."""
    row = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return values[keep], np.bincount(row[keep], minlength=len(counts)).astype(np.int64)
