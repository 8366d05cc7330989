"""Numpy kernels over the bytes of a batch of texts.

Operators of this package run these inside ``mapInArrow``: Spark deals out the rows, each Arrow batch is cut into slices of
about a megabyte of text, and a slice is handled by whole-array operations, so that memory does not depend on the rows of a
batch and no Python runs per word. A null text counts as the empty text in every kernel.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

SLICE_BYTES = 1 << 20

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018  absent from other C libraries
except (OSError, AttributeError):
    _libc = None

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
#: What stays of eight bytes of which so many belong to a range.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that end at ASCII white space: ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of lower-cased words of letters and digits: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: First bytes of UTF-8 sequences: as many as there are code points.
LEAD = (np.arange(256) & 0xC0) != 0x80


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one slice take about ``limit`` bytes; a longer text is a slice of its own."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.cumsum(np.diff(raw(batch.column(column))[1]))
            at = 0
            while at < batch.num_rows:
                base = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
                yield batch.slice(at, to - at)
                at = to
            del batch
    finally:
        give_back()


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers for later tasks, and idle ones shouldn't hold any."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return bytes_, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _summed(values: np.ndarray, count: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """One hash for each range from its parts (``count`` of them, in order): each is scattered with its place, then they are added up.

    No algebra ties the parts of a range together, so that regular texts don't meet, as they do in a polynomial.
    """
    place = (np.arange(len(values)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(mix(values ^ np.uint64(seed)) + place * _ODD), out=sums[1:])
    ends = np.cumsum(count)
    return mix(sums[ends] - sums[ends - count] + size.astype(np.uint64) * _STEP)


def bytes_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of ranges of bytes; equal ranges have equal hashes wherever they lie. Work grows with the ranges' total length."""
    size = end - start
    count = (size + 7) >> 3
    first = np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(start, count) + ((np.arange(len(first)) - first) << 3)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[at]
    return _summed(eights & _MASKS[np.minimum(np.repeat(end, count) - at, 8)], count, size, seed)


def run_hashes(hashes: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 0) -> np.ndarray:
    """As :func:`bytes_hashes`, of ranges of 64-bit values (words)."""
    size = high - low
    first = np.repeat(np.cumsum(size) - size, size)
    return _summed(hashes[np.repeat(low, size) + np.arange(len(first)) - first], size, size, seed)


class Words:
    """Where the words of some texts begin and end, and which text each is in."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        inside = kind[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            filled = offsets[:-1] < offsets[1:]
            at, to = offsets[:-1][filled], offsets[1:][filled] - 1
            first[at], last[to] = inside[at], inside[to]
        self.data, self.offsets = data, offsets
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.bounds)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return bytes_hashes(self.data, self.start, self.end)


def grams(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``n`` consecutive words of one text, and the index of the first word of each."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[: len(text) - n + 1] == text[n - 1 :])
    out = hashes[at]
    for k in range(1, n):
        out = mix(out * _ODD + hashes[at + k])
    return out, at


def within(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Keys that are equal for equal hashes in the same text only."""
    return mix(hashes + (text.astype(np.uint64) + np.uint64(1)) * _ODD)


def repeats(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which entries have an equal one in the same text."""
    codes, found = pd.factorize(within(text, hashes))
    return np.bincount(codes, minlength=len(found))[codes] > 1 if len(codes) else np.zeros(0, bool)


def firsts(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which entries have no equal one before them in the same text."""
    return ~pd.Series(within(text, hashes)).duplicated().to_numpy()


def listed(values: np.ndarray, text: np.ndarray, n: int, kind: pa.DataType | None = None) -> pa.Array:
    """A list column: the values (in order of their texts) of each of ``n`` texts."""
    at = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n)))).astype(np.int32)
    values = values.view(np.int64) if values.dtype == np.uint64 else values
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind) if kind else pa.array(values))


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one for each byte or word) over each text."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
