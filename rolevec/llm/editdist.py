"""Banded bit-parallel edit distance of many pairs at once.

For every pair and every number of errors up to the threshold, one small integer
holds which of the 2 * threshold + 1 diagonals are reachable; a step over one byte of
the second string updates all of them by shifts and masks.
"""

from __future__ import annotations

import numpy as np

CELLS = 4 << 20  # bytes of padded text handled at once


def _padded(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, lead: int, fill: int) -> np.ndarray:
    """Columns of bytes: row j holds byte j - lead of every string (``fill`` outside)."""
    at = np.arange(width) - lead
    inside = (at[:, None] >= 0) & (at[:, None] < length[None, :])
    got = data[np.where(inside, start[None, :] + at[:, None], 0)].astype(np.int16)
    return np.where(inside, got, fill).astype(np.int16)


def within(data: np.ndarray, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], limit: int) -> np.ndarray:
    """Edit distance (bytes) of strings given as (start, length) in ``data``; limit + 1 if larger."""
    if limit > 7:
        raise ValueError("bands of up to 15 diagonals only")
    out = np.full(len(a[0]), limit + 1, np.int64)
    near = np.flatnonzero(np.abs(a[1] - b[1]) <= limit)
    near = near[np.argsort(-b[1][near], kind="stable")]
    at = 0
    while at < len(near):
        width = int(b[1][near[at]]) + 2 * limit + 1
        block = near[at : at + max(1, CELLS // width)]
        at += len(block)
        out[block] = _block(data, a[0][block], a[1][block], b[0][block], b[1][block], limit)
    return out


def _block(data: np.ndarray, a_start: np.ndarray, a_len: np.ndarray, b_start: np.ndarray, b_len: np.ndarray, limit: int) -> np.ndarray:
    """``b_len`` must not increase along the block."""
    if len(data) == 0:
        data = np.zeros(1, np.uint8)
    n, band = len(a_start), 2 * limit + 1
    longest = int(b_len[0]) if n else 0
    left = _padded(data, a_start, a_len, longest + band, limit, 256)
    right = _padded(data, b_start, b_len, longest, 0, 257) if longest else np.zeros((0, n), np.int16)
    full = np.uint16((1 << band) - 1)
    one = np.uint16(1)
    reach = [np.full(n, 1 << limit, np.uint16)]
    for e in range(limit):
        reach.append(reach[e] | ((reach[e] << one) & full))
    live = np.searchsorted(-b_len, -np.arange(longest), side="left")  # pairs with b_len > j
    for j in range(longest):
        m = int(live[j])
        same = np.zeros(m, np.uint16)
        for k in range(band):
            same |= (left[j + k, :m] == right[j, :m]).astype(np.uint16) << np.uint16(k)
        before = reach[0][:m].copy()
        new = before & same
        reach[0][:m] = new
        for e in range(1, limit + 1):
            old = reach[e][:m].copy()
            # a match, a substitution, a byte of b alone, a byte of a alone
            new = (old & same) | before | (before >> one) | ((new << one) & full)
            reach[e][:m] = new
            before = old
    goal = (a_len - b_len + limit).astype(np.uint16)
    out = np.full(n, limit + 1, np.int64)
    for e in range(limit, -1, -1):
        out[(reach[e] >> goal) & one == 1] = e
    return out
