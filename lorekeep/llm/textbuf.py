"""Vectorised work on whole Arrow string columns.

A text column is handled as one UTF-8 byte buffer with document offsets, so
words, hashes and per-document statistics are numpy expressions over bytes
rather than Python strings.  Batches are cut into slices of a bounded number of
bytes; one document is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice holds, unless a single document is longer.
SLICE_BYTES = 1 << 20

_U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_MULT_INV = pow(_MULT, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Everything but ASCII white space is part of a word.
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: ASCII letters and digits and every non-ASCII character are parts of a word.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_BYTE_CODE = None
_POWERS = [np.ones(1, _U64), np.ones(1, _U64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply rounds)."""
    h = h ^ (h >> _U64(33))
    h = h * _U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U64(33))
    h = h * _U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U64(33))


def _byte_codes() -> np.ndarray:
    global _BYTE_CODE
    if _BYTE_CODE is None:
        _BYTE_CODE = mix(np.arange(1, 257, dtype=_U64) * _U64(_MULT))
    return _BYTE_CODE


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier and its inverse modulo 2**64 to the powers 0..n-1."""
    if len(_POWERS[0]) < n:
        size = max(1 << 12, n + n // 16)  # a power of 2 could be twice what a slice needs, and workers keep it
        for k, base in enumerate((_MULT, _MULT_INV)):
            steps = np.full(size, base, _U64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


@dataclass
class Slice:
    """Documents row..row+n of a batch: data holds their bytes, doc i those from offsets[i] to offsets[i+1]."""

    row: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)


def slices(column: pa.Array, slice_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + slice_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        yield Slice(i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    @property
    def n(self) -> int:
        return len(self.start)

    def counts(self, n_docs: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=n_docs)


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a document boundary."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, stops = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[first] = inside[first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stops[last] = inside[last]
    return np.flatnonzero(starts), np.flatnonzero(stops) + 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, _U64)
    np.cumsum(_byte_codes()[data] * power[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(_U64))


def words(s: Slice, inside: np.ndarray, lower: bool = True) -> Words:
    data = LOWER[s.data] if lower else s.data
    start, end = spans(inside[data], s.offsets)
    doc = np.searchsorted(s.offsets, start, "right") - 1
    return Words(start, end, doc, span_hash(data, start, end))


def gram_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of width consecutive items; position i covers items i..i+width-1."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, _U64)
    out = np.full(n, width, _U64)
    for j in range(width):
        out = (out ^ h[j : j + n]) * _U64(_MULT) + _U64(j + 1)
        out ^= out >> _U64(29)
    return mix(out)


def per_doc(values: np.ndarray, counts: np.ndarray, how=np.add, empty=0) -> np.ndarray:
    """Reduce consecutive values, counts[i] of them for document i."""
    shape = (len(counts), *values.shape[1:])
    out = np.full(shape, empty, values.dtype)
    full = np.flatnonzero(counts)
    if len(full):
        begin = np.concatenate([[0], np.cumsum(counts)[:-1]])[full]
        out[full] = how.reduceat(values, begin, axis=0)
    return out


def first_column_named(names: list[str], wanted: str) -> str:
    """A column name that is not among names, for helper columns beside user columns."""
    while wanted in names:
        wanted = "_" + wanted
    return wanted
