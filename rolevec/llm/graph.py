"""Connected components of links, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolevec.llm.ship import map_batches
from rolevec.session import stage_table


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) within the given edges."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


def _contracted(edges: DataFrame) -> DataFrame:
    """Each partition's edges as stars; batches of a partition are folded into one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, np.int64)
        for batch in batches:
            a, b = local_roots(np.concatenate((a, batch.column(0).to_numpy())), np.concatenate((b, batch.column(1).to_numpy())))
            a, b = a[a != b], b[a != b]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return map_batches(edges.select("a", "b"), run, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (smallest node reachable) for every node of edges (a, b).

    Each partition first folds its edges into stars; then every round links the
    neighbours of a node to the smallest of them (larger ones, then smaller ones) until
    the stars are stable.  Aggregations combine before the shuffle; no list of
    neighbours is built; every round is a written table."""
    e = stage_table(_contracted(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")), "links")
    last = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written tables: one side of each join is a plain scan, so a node of many links can be split or met by a broadcast
        low = stage_table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "links-low")
        large = stage_table(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links-large")
        down = stage_table(large.groupBy("a").agg(F.min("b").alias("m")), "links-down")
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        e = stage_table(small.where("a <> b").distinct(), "links")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components are not stable after {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
