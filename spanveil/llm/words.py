"""Words of whole Arrow text columns as numpy arrays, and hashes of word windows.

Works on the UTF-8 bytes of a batch at once. Words are runs of bytes of a class; multi-byte
characters always belong to words, so no character is ever cut. Two words are taken as equal when
their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
SEGMENT, LONG_WORD, SLICE = 1 << 19, 1 << 16, 8 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

BLANKS = (0x20, *range(0x09, 0x0E))
NOT_ALPHANUMERIC = tuple(c for c in range(128) if not chr(c).isalnum() or chr(c).isupper())


class Words(NamedTuple):
    """Hash, first and past-the-end byte of each word; words ``first[r]:first[r+1]`` are of row r."""

    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit values (a finalizer with two multiplications)."""
    h = h ^ U(salt * BASE & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n at least."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, SEGMENT + LONG_WORD)
        both = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, base, dtype=U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        _POWERS[0] = have = (both[0], both[1])
    return have


def sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of values[start:end], independent of where they stand."""
    p, inverse = powers(len(values))
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * p[:len(values)], out=total[1:], dtype=U)
    return (total[end] - total[start]) * inverse[start]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each has at most ``most`` bytes of text, or one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at, total = 0, np.cumsum(size, dtype=np.int64)
        while at < len(size):
            before = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each row's begin (one more entry than rows); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(column: pa.Array, lower: bool = True, breaks: tuple[int, ...] = BLANKS) -> Words:
    """All words of a text column. ``breaks``: the bytes (after lower-casing) that end words."""
    data, offsets = text_bytes(column)
    if lower:
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        data = fold[data]
    inside = np.ones(256, dtype=bool)
    inside[list(breaks)] = False
    inside = inside[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)  # a word may not cross into the next row
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    if n:
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    del opens, closes, edge, inside
    out = np.empty(len(start), dtype=U)
    letters = mix(np.arange(256, dtype=U), 1)
    long = np.flatnonzero(end - start > LONG_WORD)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + SEGMENT)))
        s, e = start[a:b] - start[a], np.minimum(end[a:b], start[a:b] + LONG_WORD) - start[a]
        out[a:b] = sums(letters[data[start[a]:start[a] + e[-1]]], s, e)
        a = b
    for i in long:
        digest = hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest()
        out[i] = int.from_bytes(digest, "little")
    return Words(data, mix(out, 2), start, end, np.searchsorted(start, offsets))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, row ends ignored; fewer than k words give none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    at = np.arange(n)
    return mix(sums(hashes, at, at + k), k + 2)


def whole_windows(w: Words, k: int) -> np.ndarray:
    """For each word, whether the window of k words that starts there ends in the same row."""
    left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(len(w.hash))
    return left >= k
