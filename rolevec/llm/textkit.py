"""Vectorised text kernels shared by the operators of this subpackage.

They run inside Spark's Arrow batches: a string column is one byte buffer plus
offsets, so word boundaries and word hashes of many documents come out of a few
numpy passes.  Batches are cut into slices of bounded size; a document is never
cut.  Words are compared by 64-bit hashes of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 512 << 10  # text bytes handled at once (a longer document is one slice)

U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of splitmix64 on unsigned 64-bit integers."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and BASE**-j modulo 2**64 for j < n at least."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(19, int(n).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, U64(base), dtype=U64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


@lru_cache(maxsize=None)
def _tables(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, hash value of the byte) for the word rules.

    ``alnum``: bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
    ``space``: bytes of ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    b = np.arange(256)
    low = np.where((b >= 65) & (b <= 90), b + 32, b)
    if kind == "alnum":
        word = ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128)
    elif kind == "space":
        word = ~((low == 32) | ((low >= 9) & (low <= 13)))
    else:
        raise ValueError(f"unknown word rule {kind!r}")
    value = mix64((low + 1).astype(U64) * U64(0xD1342543DE82EF95))
    return word, np.where(word, value, U64(0))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows: (first row, row after the last, bytes, row offsets).

    Null rows are empty.  A run holds at most ``limit`` bytes unless one row alone is longer."""
    n = len(column)
    if n == 0:
        return
    if pa.types.is_null(column.type):
        yield 0, n, np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    at = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lengths = np.diff(at)
    if column.null_count:
        lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), lengths, 0)
        if (np.diff(at) != lengths).any():  # a null row may point at bytes
            column = pa.array(column.to_pylist(), pa.large_string()).fill_null("")
            yield from slices(column, limit)
            return
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Words of a run of rows: byte span and hash per word, word range per row."""

    __slots__ = ("start", "end", "hash", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: str = "alnum") -> None:
        word, value = _tables(kind)
        n = len(data)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash, self.first = np.zeros(0, U64), np.zeros(len(offsets), np.int64)
            return
        inside = np.empty(n + 1, bool)
        inside[:n] = word[data]
        inside[n] = False
        head = inside[:n].copy()
        head[1:] &= ~inside[: n - 1]
        tail = inside[:n] & ~inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        head[cuts] = inside[cuts]  # a word never spans two rows
        tail[cuts - 1] = inside[cuts - 1]
        self.start = np.flatnonzero(head)
        self.end = np.flatnonzero(tail) + 1
        up, down = _powers(n)
        sums = np.empty(n + 1, U64)
        sums[0] = 0
        terms = value[data]
        terms *= up[:n]
        np.cumsum(terms, out=sums[1:])
        self.hash = mix64((sums[self.end] - sums[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """Row of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def hash_word(word: str, kind: str = "alnum") -> int:
    """Hash of one word, the same as in :class:`Words`."""
    data = np.frombuffer(word.encode("utf-8"), np.uint8)
    w = Words(data, np.array([0, len(data)]), kind)
    if len(w.hash) != 1:
        raise ValueError(f"{word!r} is not one word")
    return int(w.hash[0])


@lru_cache(maxsize=None)
def _byte_values() -> np.ndarray:
    return mix64((np.arange(256) + 1).astype(U64) * U64(0xA0761D6478BD642F))


class Lines:
    """Lines of a run of rows (split at newlines) with hashes of any of their substrings."""

    __slots__ = ("start", "end", "row", "number", "_sums", "_down")

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        n = len(data)
        breaks = np.flatnonzero(data == 10)
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(breaks, offsets)))
        # A row of k newlines has k + 1 lines.
        start = np.concatenate((offsets[:-1], breaks + 1))
        end = np.concatenate((breaks, offsets[1:]))
        row = np.concatenate((np.arange(len(offsets) - 1), rows))
        end_row = np.concatenate((rows, np.arange(len(offsets) - 1)))
        order = np.lexsort((start, row))
        self.start, self.row = start[order], row[order]
        self.end = end[np.lexsort((end, end_row))]
        self.number = np.arange(len(order)) - np.searchsorted(self.row, self.row)
        up, self._down = _powers(max(n, 1))
        self._sums = np.zeros(n + 1, U64)
        np.cumsum(_byte_values()[data] * up[:n], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges [start, end)."""
        return mix64((self._sums[end] - self._sums[start]) * self._down[np.minimum(start, len(self._down) - 1)] + (end - start).astype(U64))
