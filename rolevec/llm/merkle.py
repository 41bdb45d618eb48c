"""Merkle manifest of a table, its nodes stored in van Emde Boas order.

Every row is a leaf: the digest of its columns.  Rows of one language form a tree, in the
order of their ids; the languages' roots form a tree above them.  Two consecutive nodes
(or a single last one) become the digest of their digests, until one is left.

1.  Leaves get their place in their tree by a range-partitioned sort (``order.in_order``).
2.  A tree is cut into aligned subtrees of ``HEIGHT`` levels.  A block stores one of them:
    the complete tree is split at half its height, the top part first, then the bottom
    trees one after another, each split likewise.  A node's place follows from its depth and
    index by arithmetic; parents are computed in that order, bottom trees before the top.
3.  The roots of the blocks are the nodes of the next round, until each tree has one block.
4.  Proofs go down the same way: a block's path to the root is joined to it once, and the
    siblings inside the block are read from its layout for all of its leaves.

Blocks hold at most 2**HEIGHT leaves, whatever the size of a language.  Rounds grow with
the logarithm of the table.

Defined results: any column may be null (``-``); rows without a language are a tree of their
own, the first; within a tree rows without an id come first, equal ids are ordered by their
digests; equal rows are separate leaves; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolevec.llm.order import in_order
from rolevec.llm.ship import map_batches, ship
from rolevec.session import stage_table

HEIGHT = 10
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ENTRY = 33  # bytes of a path's step: where the sibling stands (0: none, 1: left, 2: right), its digest


def node_place(depth: int, index: np.ndarray, levels: int) -> np.ndarray:
    """Place of nodes of one depth in the van Emde Boas order of a complete tree of so many levels."""
    index = np.asarray(index, np.int64)
    place = np.zeros(len(index), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        bottom = levels - top
        place += (1 << top) - 1 + (index >> (depth - top)) * ((1 << bottom) - 1)
        depth, levels = depth - top, bottom
        index = index & ((1 << depth) - 1)
    return place


@lru_cache(maxsize=None)
def building_order(levels: int) -> list[tuple[int, int, int, int, int]]:
    """(depth, index, place, left child's place, right child's) of the inner nodes, each
    after its children: recursively, the bottom trees, then the top."""

    def visit(depth: int, index: int, size: int) -> Iterator[tuple[int, int]]:
        if size == 1:
            yield depth, index
            return
        top = size // 2
        for t in range(1 << top):
            yield from visit(depth + top, index << top | t, size - top)
        yield from visit(depth, index, top)

    places = [node_place(d, np.arange(1 << d), levels).tolist() for d in range(levels)]
    return [(d, i, places[d][i], places[d + 1][2 * i], places[d + 1][2 * i + 1]) for d, i in visit(0, 0, levels) if d < levels - 1]


def height_of(total: int, most: int) -> int:
    """Levels above the leaves of a block of a tree of ``total`` leaves."""
    return min(most, max(0, (total - 1).bit_length()))


def build_layout(leaves: list[bytes], height: int) -> bytes:
    """All nodes of a block in van Emde Boas order; places of nodes that don't exist hold zeros.

    Inside a larger tree a block's last node goes up alone, so a block always has one root."""
    store: list[bytes] = [bytes(32)] * ((1 << (height + 1)) - 1)
    for place, leaf in zip(node_place(height, np.arange(len(leaves)), height + 1).tolist(), leaves):
        store[place] = leaf
    n = len(leaves)
    count = [-(-n >> (height - d)) for d in range(height + 1)]
    sha = hashlib.sha256
    for depth, index, place, left, right in building_order(height + 1):
        if index < count[depth]:
            pair = store[left] + store[right] if 2 * index + 1 < count[depth + 1] else store[left]
            store[place] = sha(pair.hex().encode()).digest()
    return b"".join(store)


def block_paths(layout: bytes, n: int, height: int) -> np.ndarray:
    """Steps of every leaf's path inside its block, from the leaf upwards: bytes [n, height, ENTRY]."""
    nodes = np.frombuffer(layout, np.uint8).reshape(-1, 32)
    out = np.zeros((n, height, ENTRY), np.uint8)
    leaf = np.arange(n)
    for step in range(height):
        depth = height - step
        index = leaf >> step
        sibling = index ^ 1
        there = sibling < -(-n >> step)
        out[there, step, 0] = np.where(index[there] & 1, 1, 2)
        out[there, step, 1:] = nodes[node_place(depth, sibling[there], height + 1)]
    return out


def row_digest(columns: dict[str, Column]) -> Column:
    """SHA-256 of the columns: ``-`` for a null, else length in bytes, ``:`` and value."""
    parts = []
    for name in LEAF_COLUMNS:
        text = columns[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def leaf_table(docs: DataFrame, claims: dict[str, Column] | None = None) -> DataFrame:
    """lang, doc_id, leaf, claim (the digest with ``claims`` in place of some columns).

    The only read of the texts."""
    own = {c: F.col(c) for c in LEAF_COLUMNS}
    leaf = row_digest(own)
    claim = row_digest(own | claims) if claims else leaf
    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), leaf.alias("leaf"), claim.alias("claim"))


BLOCK = "tree long, block long, total long, layout binary, root binary, ids array<long>, claims array<binary>"


def block_table(nodes: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Blocks of nodes (tree, total, pos, digest, id, claim), one group of at most 2**height rows each."""
    ship(nodes.sparkSession)

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        total = t.column("total")[0].as_py()
        layout = build_layout(t.column("digest").to_pylist(), height_of(total, height))
        one = {"tree": t.column("tree")[0].as_py(), "block": t.column("block")[0].as_py(), "total": total, "layout": layout, "root": layout[:32],
               "ids": t.column("id").to_pylist(), "claims": t.column("claim").to_pylist()}
        return pa.table({k: pa.array([v], kind) for (k, v), kind in zip(one.items(), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary())))})

    return nodes.withColumn("block", F.shiftright("pos", height)).groupBy("tree", "block").applyInArrow(build, BLOCK)


def grow(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Rounds of blocks up to the roots: the last round has one block a tree."""
    rounds = []
    while True:
        blocks = stage_table(block_table(nodes, height), "merkle-blocks")
        rounds.append(blocks)
        most = blocks.agg(F.max("total")).first()[0]
        if most is None or most <= 1 << height:
            return rounds
        above = F.ceil(F.col("total") / (1 << height)).cast("long")
        nodes = blocks.select("tree", above.alias("total"), F.col("block").alias("pos"), F.col("root").alias("digest"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("claim"))


CHILD = "tree long, pos long, id long, digest binary, claim binary, path binary, subroot binary"


def descend(rounds: list[DataFrame], paths: DataFrame, height: int = HEIGHT) -> DataFrame:
    """Leaves of the first round with their paths (``CHILD``); ``paths`` (tree, block, path,
    subroot) holds what is above the last round's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in b.schema.names}
                n, up = len(row["ids"]), height_of(row["total"], height)
                inside = block_paths(row["layout"], n, up)
                at = 32 * node_place(up, np.arange(n), up + 1)
                cols = [pa.array(np.full(n, row["tree"])), pa.array((row["block"] << height) + np.arange(n)), pa.array(row["ids"], pa.int64()),
                        pa.array([row["layout"][a : a + 32] for a in at.tolist()], pa.binary()), pa.array(row["claims"], pa.binary()),
                        pa.array([x.tobytes() + row["path"] for x in inside], pa.binary()), pa.array([row["subroot"]] * n, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["tree", "pos", "id", "digest", "claim", "path", "subroot"])

    for k in range(len(rounds) - 1, -1, -1):
        children = map_batches(rounds[k].join(paths, ["tree", "block"]), run, CHILD)
        if k == 0:
            return children
        paths = stage_table(children.select("tree", F.col("pos").alias("block"), "path", "subroot"), "merkle-paths")


def proofs(docs: DataFrame, claims: dict[str, Column] | None = None, height: int = HEIGHT) -> tuple[DataFrame, bytes | None]:
    """doc_id, leaf, claim, path, subroot of every row, and the manifest's root (None: no rows).

    ``claims`` puts other values in place of columns, as a later copy of the table might hold them."""
    leaves = stage_table(leaf_table(docs, claims), "merkle-leaves")
    placed = in_order(leaves, ["lang"], ["doc_id", "leaf"], groups=True)
    rounds = grow(placed.select(F.col("number").alias("tree"), "total", "pos", F.col("leaf").alias("digest"), F.col("doc_id").alias("id"), "claim"), height)
    trees = stage_table(rounds[-1].select(F.col("tree").alias("pos"), F.col("root").alias("digest")), "merkle-subroots")
    total = trees.count()
    none = F.lit(None)
    top = grow(trees.select(F.lit(0).cast("long").alias("tree"), F.lit(total).cast("long").alias("total"), "pos", "digest", none.cast("long").alias("id"), none.cast("binary").alias("claim")), height)
    root = top[-1].select("root").first()  # one block: the root of all
    start = docs.sparkSession.createDataFrame([(0, 0, b"", None)], "tree long, block long, path binary, subroot binary")
    above = descend(top, start, height).select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"))
    found = descend(rounds, stage_table(above, "merkle-paths"), height)
    return found.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "claim", "path", "subroot"), (bytes(root[0]) if root else None)


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a digest and its path lead to."""
    sha = hashlib.sha256
    for k in range(0, len(path), ENTRY):
        side, sibling = path[k], path[k + 1 : k + ENTRY]
        pair = digest if side == 0 else sibling + digest if side == 1 else digest + sibling
        digest = sha(pair.hex().encode()).digest()
    return digest


def siblings(path: bytes) -> bytes:
    return b"".join(path[k + 1 : k + ENTRY] for k in range(0, len(path), ENTRY) if path[k])


def folded(found: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, proof_sha256, folded_root (hex) from claims and paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column("path").to_pylist()
            hexed = lambda name: pa.array([x.hex() for x in b.column(name).to_pylist()], pa.string())
            proof = [hashlib.sha256(siblings(p).hex().encode()).hexdigest() for p in paths]
            ends = [fold(c, p).hex() for c, p in zip(b.column("claim").to_pylist(), paths)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), hexed("leaf"), hexed("subroot"), pa.array(proof, pa.string()), pa.array(ends, pa.string())],
                                             names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    return map_batches(found, run, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")


def tampered(every: int = 7) -> dict[str, Column]:
    """The planted tampering: one more character where ``every`` divides the id's CRC."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    return {"n_chars": F.when(F.coalesce(hit, F.lit(False)), F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


def manifest_digest(docs: DataFrame) -> DataFrame:
    """One row per document: its leaf, the roots above it, its proof and the check of the tampered copy."""
    found, root = proofs(docs, tampered())
    top = F.lit(root.hex() if root else "")
    return folded(found).select("doc_id", "leaf", "subroot", top.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == top).alias("verified"))
