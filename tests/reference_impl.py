"""Plain-Python restatement of the method on tiny inputs (the brute-force
oracle of the unit tests).  Dicts and loops, no Spark."""

from __future__ import annotations

from collections import Counter, defaultdict

from itertools import combinations

import numpy as np


def least_cost(values, weights, k):
    """Least weighted SSE over all ways to cut the sorted values into k runs."""
    d = len(values)
    if d <= k:
        return 0.0
    best = float("inf")
    for cuts in combinations(range(1, d), k - 1):
        total = 0.0
        for a, b in zip((0, *cuts), (*cuts, d)):
            mean = np.dot(weights[a:b], values[a:b]) / weights[a:b].sum()
            total += float(np.dot(weights[a:b], (values[a:b] - mean) ** 2))
        best = min(best, total)
    return best


def vectorize(records, lo, hi, k):
    levels = defaultdict(set)
    counts = defaultdict(Counter)
    for role, mark, seqs in records:
        lvl = int(mark)
        levels[int(role)].add(lvl)
        if lo <= lvl <= hi:
            c = counts[(int(role), lvl)]
            for t in seqs:
                c[t.split("@")[1]] += 1
    covered = sorted(r for r in levels if all(x in levels[r] for x in range(lo, hi + 1)))
    n = len(covered)
    holders = defaultdict(list)
    for r in covered:
        for x in range(lo, hi + 1):
            for m, c in counts[(r, x)].items():
                holders[(x, m)].append(c)
    ranges = {key: (max(v), min(v) if len(v) == n else 0) for key, v in holders.items()}
    scaled = {}
    for r in covered:
        for x in range(lo, hi + 1):
            for m, c in counts[(r, x)].items():
                mx, mn = ranges[(x, m)]
                scaled[(r, x, m)] = 0.0 if mx == mn else 100.0 * ((c - mn) / (mx - mn))
    padded = {}
    for r in covered:
        for x in range(lo, hi + 1):
            items = sorted(((m, v) for (rr, xx, m), v in scaled.items() if rr == r and xx == x),
                           key=lambda t: (-t[1], t[0]))[:k]
            items += [("0", 0.0)] * (k - len(items))
            for s, (m, v) in enumerate(items, 1):
                padded[(r, x, s)] = (m, v)
    return covered, ranges, scaled, padded


def reduce(padded, covered, lo, hi, column_k, n):
    cells = {}
    for (r, x, _s), (m, v) in padded.items():
        cells[(r, x, m)] = v  # in slot order: the last of equal names wins
    union = defaultdict(set)
    for (_r, x, m) in cells:
        union[x].add(m)
    costs = {}
    for x, ms in union.items():
        for m in ms:
            col = np.array([cells.get((r, x, m), 0.0) for r in covered])
            vals, cnt = np.unique(col, return_counts=True)
            costs[(x, m)] = (vals.size, least_cost(vals, cnt.astype(float), column_k))
    kept = {}
    for x in range(lo, hi + 1):
        inf = sorted(m for m in union.get(x, ()) if costs[(x, m)][0] > column_k)[:n]
        for rank, m in enumerate(inf, 1):
            kept[(x, rank)] = m
    vectors = {}
    for r in covered:
        vec = []
        for x in range(lo, hi + 1):
            for rank in range(1, n + 1):
                m = kept.get((x, rank))
                vec.append(0.0 if m is None else cells.get((r, x, m), 0.0))
        vectors[r] = vec
    return cells, union, costs, kept, vectors
