"""Bisecting k-means of many seeded fits over the same points, in shared passes.

The method is that of Spark ML's ``BisectingKMeans``: level by level the largest divisible
clusters are split in two, each split by k-means from its centre moved a little to both sides
along a random direction.  Two things differ, and neither changes what is found.  A split ends
once a pass moves no point: every further pass would repeat it, whereas Spark ML makes all
``max_iter`` of them.  And fits of the same points go on together: a pass is one Spark job that
reads the points once for all fits, so a sweep has as many passes as its longest fit.

A task holds one block of points and sends a vector per fit and child; the driver holds the
trees, k centres a fit."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolevec import defaults

# tasks get the kernel by value: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIECE = 1 << 15  # vector components of a block (256 kB of doubles)
FITS_PER_TASK = 8  # a pass of more fits has more tasks
LEVELS = 62  # children of node i are 2 i and 2 i + 1, numbers of 64 bits

Pair = tuple[np.ndarray | None, np.ndarray | None]  # centres of a node's children; None: no points there


def far(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distance per row; equal rows get equal ones, wherever they stand."""
    step = x - centre
    return (step * step).sum(axis=1)


def right_of(x: np.ndarray, pair: Pair) -> np.ndarray:
    """Is the right child's centre nearer than the left one's?"""
    left, right = pair
    if left is None or right is None:
        return np.full(len(x), left is None)
    return far(x, right) < far(x, left)


def placed(x: np.ndarray, splits: dict[int, Pair]) -> np.ndarray:
    """The node of every row, child by child down the tree."""
    at = np.ones(len(x), np.int64)
    for node in sorted(splits):  # parents come before their children
        rows = np.flatnonzero(at == node)
        at[rows] = 2 * node + right_of(x[rows], splits[node])
    return at


def _matrix(vectors: pa.Array) -> np.ndarray:
    widths = pc.list_value_length(vectors)
    low_high = pc.min_max(widths).as_py()
    flat = vectors.flatten()
    if vectors.null_count or flat.null_count or low_high["min"] != low_high["max"]:
        raise ValueError("vectors must not be null and have one width")
    x = flat.to_numpy(zero_copy_only=False).reshape(len(vectors), low_high["min"])
    if not np.isfinite(x).all():
        raise ValueError("vectors must be finite")
    return x


def _blocks(points: DataFrame, features_col: str, fits: int) -> RDD:
    """The points as matrices of up to PIECE components, which passes read without decoding rows;
    a pass of many fits has more work a point, so their blocks are dealt to more tasks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0))
                step = max(1, PIECE // max(1, x.shape[1]))
                pieces = [x[i:i + step].tobytes() for i in range(0, len(x), step)]
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(pieces), pa.int32()), pa.array(pieces, pa.binary())], names=["width", "block"])

    blocks = points.select(vector_to_array(features_col).alias("x")).mapInArrow(pack, "width int, block binary")
    if fits > FITS_PER_TASK:
        blocks = blocks.repartition(points.rdd.getNumPartitions() * -(-fits // FITS_PER_TASK))
    return blocks.rdd.map(lambda r: (r["width"], bytes(r["block"])))


@dataclass
class _Node:
    n: int
    centre: np.ndarray
    cost: float
    differs: bool  # has two different points


@dataclass
class _Tree:
    """One fit: its splits that are settled, and those under way."""

    k: int
    least: int
    max_iter: int
    random: object
    nodes: dict[int, _Node]
    splits: dict[int, Pair] = field(default_factory=dict)
    now: dict[int, Pair] = field(default_factory=dict)
    before: dict[int, Pair] | None = None
    passes: int = 0

    def __post_init__(self):
        self.needed, self.level = self.k - 1, 1
        self.start([1])

    def start(self, active: list[int]) -> None:
        """Splits of the next level: the larger ones, if there are more than needed."""
        divisible = [i for i in sorted(active) if self.nodes[i].n >= self.least and self.nodes[i].differs]
        if self.level > LEVELS:
            divisible = []
        if len(divisible) > self.needed:
            divisible = sorted(divisible, key=lambda i: -self.nodes[i].n)[:self.needed]
        self.needed -= len(divisible)
        self.level += 1
        self.now, self.before, self.passes = {i: self.sides(self.nodes[i].centre) for i in divisible}, None, 0

    def sides(self, centre: np.ndarray) -> Pair:
        """Where a split starts, drawn as Spark ML draws it."""
        noise = 1e-4 * (np.linalg.norm(centre) or 1.0) * np.array(list(self.random.doubles(len(centre)).toArray()))
        return centre - noise, centre + noise

    def advance(self, children: dict[int, _Node], moved: int) -> None:
        """After a pass: the children's means are the new centres."""
        self.passes += 1
        new = {i: tuple(c.centre if (c := children.get(j)) else None for j in (2 * i, 2 * i + 1)) for i in self.now}
        if moved and self.passes < self.max_iter:
            self.before, self.now = self.now, new
            return
        self.splits |= new
        self.nodes |= children
        self.start(list(children))

    def leaves(self) -> list[int]:
        """Nodes without children, from left to right."""
        out, todo = [], [1]
        while todo:
            node = todo.pop()
            if node in self.splits:
                todo += [j for j, c in zip((2 * node + 1, 2 * node), reversed(self.splits[node])) if c is not None]
            else:
                out.append(node)
        return out


@dataclass
class BisectingSummary:
    predictions: DataFrame
    trainingCost: float


class BisectingFit:
    """A fitted tree: ``clusterCenters``, ``transform`` and ``summary`` as of a Spark ML model."""

    def __init__(self, tree: _Tree, points: DataFrame, features_col: str):
        self._leaves, self._splits, self._features = tree.leaves(), tree.splits, features_col
        self._centres = [tree.nodes[j].centre for j in self._leaves]
        self.summary = BisectingSummary(self.transform(points), float(sum(tree.nodes[j].cost for j in self._leaves)))

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802 - the name that Spark ML's models have
        return self._centres

    def transform(self, points: DataFrame) -> DataFrame:
        """Adds ``prediction``; no row moves."""
        splits, order = self._splits, np.array(self._leaves)
        by_node = np.argsort(order)

        @F.arrow_udf("int")
        def leaf(vectors: pa.Array) -> pa.Array:
            if len(vectors) == 0:
                return pa.array([], pa.int32())
            at = placed(_matrix(vectors), splits)
            return pa.array(by_node[np.searchsorted(order[by_node], at)], pa.int32())

        return points.withColumn("prediction", leaf(vector_to_array(self._features)))


def _merged(a: dict, b: dict) -> dict:
    """Sums of two parts of the points."""
    for key, (n, moved, cost, total, one, differs) in b.items():
        if key in a:
            n0, moved0, cost0, total0, one0, differs0 = a[key]
            a[key] = n0 + n, moved0 + moved, cost0 + cost, total0 + total, one0, differs0 or differs or bool((one0 != one).any())
        else:
            a[key] = n, moved, cost, total, one, differs
    return a


def _pass(blocks: RDD, trees: dict[int, _Tree]) -> dict[int, tuple[dict[int, _Node], int]]:
    """One pass of all fits over the points: per fit the children of its splits, and how many points moved."""
    state = {f: (t.splits, t.now, t.before) for f, t in trees.items()}

    def sums(part: Iterator[tuple[int, bytes]]) -> Iterator[dict]:
        got: dict[tuple[int, int], tuple] = {}
        for width, block in part:
            x = np.frombuffer(block, np.float64).reshape(-1, width)
            for f, (splits, now, before) in state.items():
                at = placed(x, splits)
                for node, pair in now.items():
                    of = x[at == node]
                    side = right_of(of, pair)
                    moved = np.ones(len(of), bool) if before is None else side != right_of(of, before[node])
                    for j in (0, 1):
                        mine = of[side == j]
                        if len(mine):
                            differs = bool((mine[-1] != mine[0]).any() or (mine != mine[0]).any())
                            _merged(got, {(f, 2 * node + j): (len(mine), int(moved[side == j].sum()), float(far(mine, pair[j]).sum()), mine.sum(axis=0), mine[0].copy(), differs)})
        yield got

    found: dict[int, tuple[dict[int, _Node], int]] = {f: ({}, 0) for f in trees}
    # an entry per fit and child
    for (f, child), (n, moved, cost, total, _, differs) in blocks.mapPartitions(sums).treeReduce(_merged).items():
        centre = total / n
        # squared distances to the old centre, less those of the mean to it
        cost = max(0.0, cost - n * float(far(centre[None], trees[f].now[child // 2][child % 2])[0]))
        found[f][0][child] = _Node(n, centre, cost, differs)
        found[f] = found[f][0], found[f][1] + moved
    return found


def bisecting_fits(points: DataFrame, fits: list[tuple[int, int | None]], max_iter: int = defaults.FINAL_MAX_ITER,
                   min_divisible: float = defaults.MIN_DIVISIBLE_SIZE, features_col: str = "features") -> list[BisectingFit]:
    """A fitted tree per ``(k, seed)`` of ``fits``, all over the same points and in the same passes."""
    if max_iter <= 0:
        raise ValueError(f"number of iterations must be positive, got {max_iter}")
    if any(k < 2 for k, _ in fits):
        raise ValueError("a bisecting fit has at least two clusters")
    random = points.sparkSession.sparkContext._jvm.java.util.Random
    blocks = _blocks(points, features_col, len(fits)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # all points lie on one side of a split without a right child
        whole = _Tree(1, 0, 1, None, {1: _Node(0, np.zeros(0), 0.0, False)})
        whole.now = {1: (np.zeros(blocks.first()[0]), None)}
        first = _pass(blocks, {0: whole})[0][0][2]
        whole.now = {1: (first.centre, None)}
        root = _pass(blocks, {0: whole})[0][0][2]  # the squared distances to the mean
        least = math.ceil(min_divisible if min_divisible >= 1 else min_divisible * root.n)
        trees = [_Tree(k, least, max_iter, random() if seed is None else random(int(seed)), {1: root}) for k, seed in fits]
        while running := {f: t for f, t in enumerate(trees) if t.now}:
            for f, (children, moved) in _pass(blocks, running).items():
                trees[f].advance(children, moved)
    finally:
        blocks.unpersist()
    return [BisectingFit(t, points, features_col) for t in trees]
