"""Embedding near-dedup by collision counting on one-dimensional projections.

Unit vectors are projected on ``PROJECTIONS`` random directions.  Vectors of a block are
sorted by each projection; around every query's value lies a window, and the vectors in
it collide with the query.  The windows are differences of prefix bitsets of the sorted
order, and bit-sliced counters add them up for all pairs of two blocks.  Pairs with at
least the calibrated number of collisions are verified by their cosine in doubles.

The count is calibrated by the binomial law: a pair of cosine ``COSINE`` reaches it with
probability ``RECALL`` at least, more similar pairs with more.

Equal vectors are one class, found by an aggregation; classes are compared, block by
block, each block pair in one task of bounded memory.  A task returns link counts and
spanning links, never the pairs of a group.  The work is the number of block pairs.

Defined results: a null or zero vector, or one with a null or non-finite component, links
with nothing and is kept; vectors of different lengths don't link; rows without an id
are left out of links; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolevec.llm.graph import components, local_roots
from rolevec.llm.ship import map_groups
from rolevec.session import stage_table

COSINE = 0.9
PROJECTIONS = 32
RECALL = 0.99
WINDOW = 1.5  # half width of a window, in distances of a pair of cosine COSINE
BLOCK = 2048
SEED = 20240229

U64 = np.uint64


def directions(dim: int, n: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, n))


def needed_collisions(n: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """Most collisions that a pair at the threshold reaches with the wanted probability."""
    p = 2 * NormalDist().cdf(window) - 1
    tail, k = 0.0, n
    while k > 0:
        tail += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if tail >= recall:
            return k
        k -= 1
    return 1


def window_masks(queries: np.ndarray, values: np.ndarray, half: float) -> np.ndarray:
    """Bitset rows: which ``values`` lie within ``half`` of each query."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    words = -(-len(values) // 64)
    prefix = np.zeros((len(values) + 1, words), U64)
    prefix[np.arange(1, len(values) + 1), order >> 6] = U64(1) << (order & 63).astype(U64)
    np.bitwise_or.accumulate(prefix, axis=0, out=prefix)
    lo = np.searchsorted(ranked, queries - half, side="left")
    hi = np.searchsorted(ranked, queries + half, side="right")
    return prefix[hi] ^ prefix[lo]


def frequent_pairs(a: np.ndarray, b: np.ndarray, half: float, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two projection tables that collide at least ``needed`` times."""
    planes: list[np.ndarray] = []
    for j in range(a.shape[1]):
        carry = window_masks(a[:, j], b[:, j], half)
        for plane in planes:
            carry, plane[...] = plane & carry, plane ^ carry
        if (j + 1) & j == 0:  # a further digit is needed from here
            planes.append(carry)
    if needed >> len(planes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    above = np.zeros_like(planes[0])
    equal = np.full_like(above, ~U64(0))
    for k in range(len(planes) - 1, -1, -1):
        if needed >> k & 1:
            equal &= planes[k]
        else:
            above |= equal & planes[k]
            equal &= ~planes[k]
    mask = above | equal if needed else np.full_like(above, ~U64(0))
    rows, words = np.nonzero(mask)
    bits = np.unpackbits(mask[rows, words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(bits)
    x, y = rows[at], words[at] * 64 + bit
    inside = y < len(b)
    return x[inside], y[inside]


def block_links(left: np.ndarray, right: np.ndarray, cosine: float = COSINE, same: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of two blocks of unit vectors found with at least the cosine."""
    p = directions(left.shape[1])
    half = WINDOW * math.sqrt(max(0.0, 2 - 2 * cosine))
    x, y = frequent_pairs(left @ p, right @ p, half, needed_collisions())
    if same:
        x, y = x[x < y], y[x < y]
    ok = np.zeros(len(x), bool)
    for c in range(0, len(x), 1 << 16):
        s = slice(c, c + (1 << 16))
        ok[s] = np.einsum("ij,ij->i", left[x[s]], right[y[s]]) >= cosine
    return x[ok], y[ok]


def vector_classes(vectors: DataFrame) -> DataFrame:
    """embedding, class_id (smallest id), size of every distinct usable vector."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda v: v != 0))
    return usable.groupBy("embedding").agg(F.min(F.col("vec_id").cast("long")).alias("class_id"), F.count(F.lit(1)).alias("size"))


def class_links(classes: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """node, n (vectors linked directly from other classes), root (spanning links), in parts."""
    total = classes.count()
    blocks = max(1, -(-total // block))
    own = F.pmod(F.xxhash64("class_id"), F.lit(blocks)).cast("int")
    known = classes.select("class_id", "size", F.col("embedding").cast("array<double>").alias("x"), F.size("embedding").alias("dim"), own.alias("own"))
    cell = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    dealt = known.withColumn("cell", F.explode(cell)).select("dim", "cell.i", "cell.j", "own", "class_id", "size", "x")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        sides = [pdf[pdf["own"] == k] for k in ((i, j) if i != j else (i,))]
        if any(len(s) == 0 for s in sides):
            return pd.DataFrame({"node": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})
        unit = []
        for s in sides:
            m = np.stack(s["x"].to_list())
            m = m / np.abs(m).max(1, keepdims=True)  # no overflow in the norm
            unit.append(m / np.sqrt((m * m).sum(1, keepdims=True)))
        x, y = block_links(unit[0], unit[-1], cosine, same=i == j)
        ids, sizes = [s["class_id"].to_numpy() for s in sides], [s["size"].to_numpy() for s in sides]
        a, b = ids[0][x], ids[-1][y]
        node, root = local_roots(a, b)
        n = np.bincount(np.searchsorted(node, np.concatenate((a, b))), np.concatenate((sizes[-1][y], sizes[0][x])), minlength=len(node)).astype(np.int64)
        return pd.DataFrame({"node": node, "n": n, "root": root})

    return map_groups(dealt, ["dim", "i", "j"], compare, "node long, n long, root long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    classes = stage_table(vector_classes(vectors), "vector-classes")
    links = stage_table(class_links(classes, cosine), "vector-links")
    counts = links.groupBy("node").agg(F.sum("n").alias("n"))
    comps = components(links.select(F.col("root").alias("a"), F.col("node").alias("b")))
    named = (classes.join(counts, classes["class_id"] == counts["node"], "left").drop("node").join(comps, F.col("class_id") == comps["node"], "left")
             .select(F.col("embedding").alias("__embedding"), (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component_id")))
    named = stage_table(named, "vector-named")
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").join(named, F.col("embedding") == F.col("__embedding"), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long")).alias("n_links"),
                      component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
