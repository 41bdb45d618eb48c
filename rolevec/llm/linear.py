"""Hashed byte features and linear models, fitted on bounded samples.

A row's features are counts of hashed byte trigrams (runs of three mapped bytes
around every counted byte), square-rooted and scaled to unit length.  Rows are
handled a hundred at a time, so the dense block stays small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from rolevec.llm.textkit import slices

BUCKETS = 4096
BLOCK_ROWS = 128
BLANK = 32


def letter_table() -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters and non-ASCII bytes count; everything else is a blank."""
    b = np.arange(256)
    low = np.where((b >= 65) & (b <= 90), b + 32, b)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    return np.where(letter, low, BLANK).astype(np.uint64), letter


def raw_table() -> tuple[np.ndarray, np.ndarray]:
    """All bytes as they are, digits as one; white space is a blank that doesn't count."""
    b = np.arange(256)
    white = (b == 32) | ((b >= 9) & (b <= 13))
    return np.where(white, BLANK, np.where((b >= 48) & (b <= 57), 48, b)).astype(np.uint64), ~white


def row_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Like ``slices``, with at most ``BLOCK_ROWS`` rows each."""
    for lo, hi, data, off in slices(column):
        for a in range(0, hi - lo, BLOCK_ROWS):
            z = min(a + BLOCK_ROWS, hi - lo)
            yield lo + a, lo + z, data[off[a] : off[z]], off[a : z + 1] - off[a]


def trigrams(data: np.ndarray, off: np.ndarray, table: tuple[np.ndarray, np.ndarray], buckets: int = BUCKETS) -> np.ndarray:
    """Unit-length feature rows (float32); a row without counted bytes is all zero."""
    value, counted = table
    rows, n = len(off) - 1, len(data)
    if n == 0:
        return np.zeros((rows, buckets), np.float32)
    here = value[data]
    before, after = np.empty_like(here), np.empty_like(here)
    before[0], before[1:] = BLANK, here[:-1]
    after[-1], after[:-1] = BLANK, here[1:]
    start, end = off[:-1], off[1:]
    full = end > start
    before[start[full]] = BLANK  # no trigram spans two rows
    after[end[full] - 1] = BLANK
    code = (before << np.uint64(16)) | (here << np.uint64(8)) | after
    bucket = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (buckets - 1).bit_length())).astype(np.int64)
    row = np.repeat(np.arange(rows), end - start)
    keep = counted[data]
    x = np.bincount(row[keep] * buckets + bucket[keep], minlength=rows * buckets).reshape(rows, buckets).astype(np.float32)
    np.sqrt(x, out=x)
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=x, where=norm > 0)


class Rows:
    """Feature rows gathered into one block; memory is touched as rows come."""

    def __init__(self, most: int, buckets: int = BUCKETS) -> None:
        self.x, self.n = np.empty((most, buckets), np.float32), 0

    def add(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.x):
            self.x = np.concatenate((self.x[: self.n], np.empty((max(len(rows), len(self.x)), self.x.shape[1]), np.float32)))
        self.x[self.n : self.n + len(rows)] = rows
        self.n += len(rows)

    def block(self) -> np.ndarray:
        return self.x[: self.n]


def _descend(x: np.ndarray, slope: Callable[[np.ndarray], np.ndarray], bend: float, l2: float, rounds: int) -> np.ndarray:
    """Accelerated gradient descent on mean loss(x w + b) + l2/2 |w|^2; the last weight is b."""
    n, d = x.shape
    v = np.full(d, 1 / np.sqrt(d), np.float32)
    for _ in range(12):  # largest singular value, for the step
        v = x.T @ (x @ v)
        v /= max(float(np.linalg.norm(v)), 1e-12)
    lip = bend * (float(np.linalg.norm(x @ v)) ** 2 / n * 1.1 + 1) + l2
    w = np.zeros(d + 1)
    look, t = w.copy(), 1.0
    for _ in range(rounds):
        g = slope((x @ look[:-1].astype(np.float32)).astype(float) + look[-1])
        step = np.append(x.T @ g.astype(np.float32) / n + l2 * look[:-1], g.mean())
        new = look - step / lip
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def fit_svm(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Linear support vector machine (squared hinge); y is +1 or -1, rows with 0 don't count."""
    weight = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), np.where(y < 0, 0.5 / max((y < 0).mean(), 1e-9), 0.0))
    return _descend(x, lambda s: -2 * weight * y * np.maximum(0, 1 - y * s), 2 * float(weight.max(initial=1.0)), l2, rounds)


def fit_logistic(x: np.ndarray, p: np.ndarray, l2: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """Logistic regression towards probabilities ``p``."""
    return _descend(x, lambda s: sigmoid(s) - p, 0.25, l2, rounds)


def sigmoid(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def scores(x: np.ndarray, models: np.ndarray) -> np.ndarray:
    """Decision values of rows for a stack of models (last weight is the offset)."""
    return (x @ models[:, :-1].T.astype(np.float32)).astype(float) + models[:, -1]
