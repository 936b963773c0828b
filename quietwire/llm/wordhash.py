"""Vectorised word splitting and hashing over the buffers of an Arrow text column.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, which in UTF-8 is the same as a run of characters outside
them. Hashes are polynomials modulo 2**64 over bytes (for words) or over mixed word hashes (for n-grams and windows),
read off prefix sums, then passed through a 64-bit finaliser.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * _U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * _U(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


_BYTES = Powers(0x9E3779B97F4A7C15)
_BYTES_2 = Powers(0xC2B2AE3D27D4EB4F)
_WORDS = Powers(0xD6E8FEB86659FD93)
_WORDS_2 = Powers(0xA0761D6478BD642F)


def _runs(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of values[start:end] for each pair, independent of where the run stands."""
    up, down = powers.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of consecutive documents: hashes, and where each document's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        is_word = _IS_WORD[data]
        n = len(data)
        filled = offsets[:-1] < offsets[1:]
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = is_word[:-1], is_word[1:]
        before[offsets[:-1][filled]] = False
        after[offsets[1:][filled] - 1] = False
        self.starts = np.flatnonzero(is_word & ~before)
        self.ends = np.flatnonzero(is_word & ~after) + 1
        self.values = (_LOWER[data] if lower else data).astype(np.uint64) + _U(1)
        #: Document i has words first[i] to first[i + 1].
        self.first = np.searchsorted(self.starts, offsets)
        self.hashes = _runs(self.values, self.starts, self.ends, _BYTES)

    def second_hashes(self) -> np.ndarray:
        return _runs(self.values, self.starts, self.ends, _BYTES_2)

    def documents(self) -> Iterator[tuple[int, int]]:
        return zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)


def sequence_hashes(words: np.ndarray, width: int, second: bool = False) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive words of one document; empty if it has fewer words."""
    starts = np.arange(max(0, len(words) - width + 1))
    return _runs(words, starts, starts + width, _WORDS_2 if second else _WORDS) if len(starts) else np.empty(0, np.uint64)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a document with fewer words has its whole sequence as its one shingle."""
    return np.unique(sequence_hashes(words, min(width, len(words)))) if len(words) else np.empty(0, np.uint64)


def digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first document, bytes, offsets from 0) of runs of whole documents; nulls count as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def documents(column: pa.Array, lower: bool) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(index, word hashes, raw bytes) of each document of an Arrow batch."""
    for i, data, offsets in slices(column):
        words = Words(data, offsets, lower)
        for k, (a, b) in enumerate(words.documents()):
            yield i + k, words.hashes[a:b], data[offsets[k] : offsets[k + 1]]
