"""FM-index over a sequence of integer symbols, vectorised over many patterns.

Symbol 0 is the break between segments; no pattern holds it.  Breaks compare by
position, so a suffix comparison never runs past its segment.  The index keeps
the wavelet-matrix form of the Burrows-Wheeler transform (packed bits with block
counts) and suffix positions at every ``step``-th symbol and at segment starts.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ``text`` must end with a break (0)."""
    n = len(text)
    breaks = text == 0
    n_breaks = int(breaks.sum())
    rank = text.astype(np.int64) + n_breaks
    rank[breaks] = np.arange(n_breaks)
    bits = max(1, int(rank.max()).bit_length())
    span = max(1, 62 // bits)
    key = rank.copy()
    for j in range(1, span):  # the first symbols packed into one key
        key <<= bits
        if j < n:
            key[: n - j] |= rank[j:]
    order = np.argsort(key)
    slots = np.arange(n)
    sorted_key = key[order]
    depth = span
    while True:
        new = np.empty(len(order), bool)
        new[0] = True
        np.not_equal(sorted_key[1:], sorted_key[:-1], out=new[1:])
        heads = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        rank[order] = slots[heads]
        if depth == span:
            full = order
        else:
            full[slots] = order
        single = new & np.append(new[1:], True)
        if single.all():
            return full
        order, slots = order[~single], slots[~single]
        key = rank[order] * n + rank[np.minimum(order + depth, n - 1)]
        perm = np.argsort(key)
        order, sorted_key = order[perm], key[perm]
        depth *= 2


class Wavelet:
    """Wavelet matrix: rank of a symbol before a position, and access."""

    def __init__(self, seq: np.ndarray, n_symbols: int) -> None:
        self.n, self.levels = len(seq), max(1, int(n_symbols - 1).bit_length())
        self.words, self.before, self.zeros = [], [], []
        n_words = self.n // 64 + 1
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            packed = np.zeros(n_words * 8, np.uint8)
            raw = np.packbits(bit, bitorder="little")
            packed[: len(raw)] = raw
            words = packed.view(U64)
            before = np.zeros(n_words + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=before[1:])
            self.words.append(words)
            self.before.append(before)
            self.zeros.append(self.n - int(before[-1]))
            seq = np.concatenate((seq[~bit], seq[bit]))
        self.start = self._walk(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        part = self.words[k][block] & ((U64(1) << (i & 63).astype(U64)) - U64(1))
        return self.before[k][block] + np.bitwise_count(part)

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self._ones(k, i)
            set_bit = (symbol >> (self.levels - 1 - k)) & 1
            i = np.where(set_bit == 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``i``."""
        return self._walk(symbol, i) - self.start[symbol]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol at ``i`` and its rank there."""
        symbol = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            ones = self._ones(k, i)
            bit = ((self.words[k][i >> 6] >> (i & 63).astype(U64)) & U64(1)).astype(np.int64)
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
            symbol = symbol * 2 + bit
        return symbol, i - self.start[symbol]


class FMIndex:
    """Backward search and location over one shard."""

    def __init__(self, text: np.ndarray, n_symbols: int, step: int = 8) -> None:
        if len(text) == 0 or text[-1] != 0:
            raise ValueError("the text must end with a break")
        order = suffix_order(text)
        self.wavelet = Wavelet(text[order - 1], n_symbols)
        self.less = np.zeros(n_symbols + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=n_symbols), out=self.less[1:])
        after_break = np.roll(text, 1)[order] == 0
        keep = after_break | (order % step == 0)
        self.sample_row, self.sample_pos = np.flatnonzero(keep), order[keep]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of left-padded patterns (rows of symbols)."""
        m, width = patterns.shape
        lo = np.zeros(m, np.int64)
        hi = np.full(m, self.wavelet.n, np.int64)
        for j in range(width - 1, -1, -1):
            live = np.flatnonzero((lengths > width - 1 - j) & (hi > lo))
            if len(live) == 0:
                continue
            c = patterns[live, j]
            lo[live] = self.less[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.less[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by stepping back to a sampled one."""
        out = np.empty(len(rows), np.int64)
        todo, at, steps = np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            near = np.minimum(np.searchsorted(self.sample_row, at), len(self.sample_row) - 1)
            found = self.sample_row[near] == at
            out[todo[found]] = self.sample_pos[near[found]] + steps
            todo, at = todo[~found], at[~found]
            symbol, r = self.wavelet.access(at)
            at, steps = self.less[symbol] + r, steps + 1
        return out
