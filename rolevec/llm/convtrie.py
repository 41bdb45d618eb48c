"""Prefix trie of conversations, by union-find over the LCP of sorted neighbours.

A conversation is its sequence of turns (role, text).  Every distinct sequence of its first
d turns is a node; conversations that begin with it are the node's members.

1.  Turns get their depth by a range-partitioned sort (``order.in_order``); a prefix is known
    by 128 bits, the XOR of its turns' hashes, each taken with its depth.
2.  Conversations are cut into chunks of ``CHUNK`` turns.  Chunks are sorted by (chunk number,
    the prefix before it, their prefixes), so that members of a node are neighbours.
3.  A run of sorted rows becomes a forest: neighbours are linked by an edge as deep as their
    longest common prefix, and a union-find takes the edges in descending depth.  A merge
    makes the branching node at that depth; the unary nodes below it have the members of
    the part they belong to.
4.  Nodes that touch neither end of a run are complete.  The others, at most 2 (CHUNK + 1) a
    run, are what is left of the contracted forest; parts of the same node are merged by its
    prefix, across runs and partitions.
5.  Sums over subtrees go through the members: what a node adds is booked on its smallest
    member at its depth, running sums from the deepest turn upwards give each member's share
    at every depth, and a node adds up the shares of its members.

No task holds a conversation, a node's members or a run longer than an Arrow batch.  The
digest of the members that end at a node is one pass over packed, sorted ids.

Defined results: null role or text: empty; turns with equal numbers: by role, then by the
turn's SHA-256; rows without a conversation id are left out; repeated rows are turns of their
own; an empty table gives no rows, not even the root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolevec.llm.order import in_order, starts_of
from rolevec.llm.ship import map_batches
from rolevec.session import stage_table

CHUNK = 32
STRIDE, SHARED = 20, 4  # conversation c begins with the first crc32(c) % SHARED turns of c - c % STRIDE
PIECE = 1000  # ids of a packed piece
WORD = r"[^\x20\x09-\x0D]+"


def turn_table(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (of role and text), words.  The only read of the texts."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from another one."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("long")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth from 1, digest, words) of the rebuilt conversations, and all conv_ids."""
    placed = stage_table(in_order(turns, ["conv_id"], ["turn", "role", "digest"]).select("conv_id", "pos", "digest", "words"), "conversation-turns")
    heads = stage_table(placed.where((F.col("conv_id") % STRIDE == 0) & (F.col("pos") < SHARED - 1)), "conversation-heads")
    have = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("n"))
    convs = placed.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % STRIDE).alias("base"), borrowed(F.col("conv_id")).alias("h"))
    convs = stage_table(convs.join(have, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("taken")), "conversations")
    own = placed.where(F.col("pos") >= borrowed(F.col("conv_id")))
    # only conversations that found fewer turns than they asked for move up
    fewer = convs.where("taken < h").select(F.col("conv_id").alias("__conv"), (F.col("h") - F.col("taken")).alias("less"))
    own = own.join(fewer, F.col("conv_id") == F.col("__conv"), "left").select("conv_id", (F.col("pos") + 1 - F.coalesce("less", F.lit(0))).alias("depth"), "digest", "words")
    first = convs.join(heads.select(F.col("conv_id").alias("base"), "pos", "digest", "words"), "base").where("pos < taken")
    return first.select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "words").unionByName(own), convs.select("conv_id")


def prefix_table(turns: DataFrame) -> DataFrame:
    """conv_id, depth, words of the last turn, a, b (the prefix), pa, pb (the prefix before it)."""
    tagged = turns.select("conv_id", "depth", "words", F.xxhash64("digest", "depth").alias("x"), F.xxhash64(F.lit(7), "digest", "depth").alias("y"))
    chained = in_order(stage_table(tagged, "rebuilt-turns"), ["conv_id"], ["depth"], xors=["x", "y"])
    return chained.select("conv_id", "depth", "words", F.col("before_x").bitwiseXOR(F.col("x")).alias("a"), F.col("before_y").bitwiseXOR(F.col("y")).alias("b"),
                          F.col("before_x").alias("pa"), F.col("before_y").alias("pb"))


def chunk_table(prefixes: DataFrame, convs: DataFrame, size: int = CHUNK) -> DataFrame:
    """chunk, ca, cb (the prefix before the chunk), path (prefixes inside), words, conv_id."""
    chunk = F.floor((F.col("depth") - 1) / size).cast("long")
    step = F.struct("depth", "a", "b", "words", "pa", "pb")
    cut = prefixes.select("conv_id", chunk.alias("chunk"), step.alias("s")).groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("s")).alias("s"))  # at most ``size``
    rows = cut.select("chunk", F.col("s")[0]["pa"].alias("ca"), F.col("s")[0]["pb"].alias("cb"), F.transform("s", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("path"),
                      F.transform("s", lambda x: x["words"]).alias("words"), "conv_id")
    # a conversation without turns is a member of the root alone
    spoken = rows.where("chunk = 0").select("conv_id")
    empty = convs.join(spoken, "conv_id", "left_anti").select(F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("ca"), F.lit(0).cast("long").alias("cb"),
                                                             F.expr("cast(array() as array<struct<a: bigint, b: bigint>>)").alias("path"), F.expr("cast(array() as array<bigint>)").alias("words"), "conv_id")
    return rows.unionByName(empty)


def forest(lcp: list[int], length: list[int], conv: list[int], floor: list[int]) -> list[tuple[int, int, int, int, int, int, int]]:
    """Nodes of sorted sequences as segments (a member's row, first depth, last depth, members,
    smallest conversation, first row, last row) of equal members.

    ``lcp[i]`` joins rows i and i + 1 (-1: they share nothing, not even the start);
    ``floor[i]`` is the least depth of row i that counts."""
    n = len(length)
    root, depth, size, low = list(range(n)), list(length), [1] * n, list(conv)
    first, last = list(range(n)), list(range(n))
    out = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def close(x: int, above: int) -> None:
        """The part's nodes deeper than ``above`` are done."""
        if depth[x] > above:
            out.append((first[x], above + 1, depth[x], size[x], low[x], first[x], last[x]))
            depth[x] = above

    for e in sorted((e for e in range(n - 1) if lcp[e] >= 0), key=lambda e: -lcp[e]):
        x, y = find(e), find(e + 1)
        close(x, lcp[e])
        close(y, lcp[e])
        if size[x] < size[y]:
            x, y = y, x
        root[y] = x
        size[x] += size[y]
        low[x], first[x], last[x] = min(low[x], low[y]), min(first[x], first[y]), max(last[x], last[y])
    for x in range(n):
        if root[x] == x:
            close(x, floor[x] - 1)
    return out


NODE = "depth long, a long, b long, pa long, pb long, words long, n_convs long, conv_id long, open boolean"


def forest_nodes(chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """Nodes (``NODE``) of the runs of sorted chunks; open ones may go on in other runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            chunk, ca, cb, conv = (batch.column(c).to_numpy() for c in ("chunk", "ca", "cb", "conv_id"))
            path = batch.column("path")
            at = np.frombuffer(path.buffers()[1], np.int32)[path.offset : path.offset + n + 1].astype(np.int64)
            steps = path.values
            a, b = steps.field(0).to_numpy(), steps.field(1).to_numpy()
            words_at = batch.column("words")
            first_word = np.frombuffer(words_at.buffers()[1], np.int32)[words_at.offset]
            words = words_at.values.to_numpy()[first_word:]
            length = np.diff(at)
            width = max(1, int(length.max()))
            column = np.arange(width)
            there = column[None, :] < length[:, None]
            pick = np.minimum(at[:-1, None] + column[None, :], max(len(a) - 1, 0))
            A, B = (v[pick] if len(v) else np.zeros(pick.shape, np.int64) for v in (a, b))
            same = (A[1:] == A[:-1]) & (B[1:] == B[:-1]) & there[1:] & there[:-1]
            lcp = np.where((chunk[1:] == chunk[:-1]) & (ca[1:] == ca[:-1]) & (cb[1:] == cb[:-1]), same.sum(1), -1)
            parts = forest(lcp.tolist(), length.tolist(), conv.tolist(), np.where(chunk == 0, 0, 1).tolist())
            row, lo, hi, members, low, begin, end = (np.array(x, np.int64) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 7
            many = hi - lo + 1
            seg = np.repeat(np.arange(len(row)), many)
            d = np.arange(len(seg)) - np.repeat(np.cumsum(many) - many, many) + lo[seg]  # depth inside the chunk
            r = row[seg]
            here = np.maximum(at[r] + d - 1, 0)
            up = np.maximum(at[r] + d - 2, 0)

            def prefix(v: np.ndarray, context: np.ndarray, index: np.ndarray, inside: np.ndarray) -> np.ndarray:
                return np.where(inside, v[np.minimum(index, max(len(v) - 1, 0))] if len(v) else 0, context[r])

            null = lambda v: pa.array(v, pa.int64(), mask=(d + chunk[r] * size == 0))  # noqa: E731 - the root has no parent
            w = np.where(d > 0, words[np.minimum(here - at[0], max(len(words) - 1, 0))] if len(words) else 0, 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d + chunk[r] * size), pa.array(prefix(a, ca, here, d > 0)), pa.array(prefix(b, cb, here, d > 0)), null(prefix(a, ca, up, d > 1)), null(prefix(b, cb, up, d > 1)),
                 pa.array(w.astype(np.int64)), pa.array(members[seg]), pa.array(low[seg]), pa.array((begin[seg] == 0) | (end[seg] == n - 1))],
                names=["depth", "a", "b", "pa", "pb", "words", "n_convs", "conv_id", "open"])

    order = ["chunk", "ca", "cb", "path", "conv_id"]
    dealt = chunks.repartitionByRange(*order).sortWithinPartitions(*order)
    return map_batches(dealt.select("chunk", "ca", "cb", "path", "words", "conv_id"), run, NODE)


def merged(nodes: DataFrame) -> DataFrame:
    """Whole nodes: the open parts of a node, found by its prefix, become one."""
    same = [F.first(c).alias(c) for c in ("pa", "pb", "words")]
    joined = nodes.where("open").groupBy("depth", "a", "b").agg(*same, F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    return nodes.where("not open").drop("open").unionByName(joined)


def end_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """depth, a, b, ends_sha256 of the ids (conv_id) listed for each node."""
    key = ["depth", "a", "b"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            ids = b.column("conv_id").to_numpy()
            start = starts_of([b.column(c) for c in key])
            cuts = np.unique(np.concatenate((start, np.arange(0, b.num_rows, piece))))
            texts = [",".join(map(str, ids[x:y].tolist())) for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), b.num_rows])]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(cuts)) for c in key), pa.array(ids[cuts]), pa.array(texts, pa.string())], names=[*key, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, out = None, None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in (*key, "ids")]
            for *k, ids in zip(*cols):
                if k != now:
                    if now is not None:
                        out.append((*now, sha.hexdigest()))
                    now, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(("," + ids).encode())
            yield _rows(out)
            out = []
        if now is not None:
            yield _rows([(*now, sha.hexdigest())])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*key, "ends_sha256"])

    listed = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    pieces = map_batches(listed.select(*key, "conv_id"), pack, "depth long, a long, b long, first long, ids string")
    dealt = pieces.repartition(*key).sortWithinPartitions(*key, "first")
    return map_batches(dealt.select(*key, "ids"), digest, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, chunk: int = CHUNK, piece: int = PIECE) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    key = ["depth", "a", "b"]
    zero = F.lit(0).cast("long")
    turns, convs = rebuilt(stage_table(turn_table(conversations), "turns"))
    prefixes = stage_table(prefix_table(turns), "prefixes")
    nodes = stage_table(merged(stage_table(forest_nodes(stage_table(chunk_table(prefixes, convs, chunk), "chunks"), chunk), "forest")), "trie-nodes")
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage_table(nodes.join(kids, key, "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie")
    # shares: booked on the smallest member, summed from below, collected from all members
    member = prefixes.select("conv_id", *key).unionByName(convs.select("conv_id", *(zero.alias(c) for c in key)))
    member = stage_table(member, "members")
    saved, leaf = ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf")
    booked = nodes.where("n_children = 0 or (n_convs > 1 and words > 0)").select("conv_id", (-F.col("depth")).alias("up"), F.lit(0).alias("kind"), saved, leaf, zero.alias("a"), zero.alias("b"))
    asked = member.select("conv_id", (-F.col("depth")).alias("up"), F.lit(1).alias("kind"), zero.alias("saved"), zero.alias("leaf"), "a", "b")
    shares = in_order(stage_table(booked.unionByName(asked), "shares"), ["conv_id"], ["up", "kind"], sums=["saved", "leaf"]).where("kind = 1")
    totals = shares.groupBy((-F.col("up")).alias("depth"), "a", "b").agg(F.sum("before_saved").alias("saved_tokens"), F.sum("before_leaf").alias("n_leaves"))
    last = member.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("e")).select("conv_id", "e.*")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, key).join(end_digests(stage_table(last, "ends"), piece), key, "left")
    out = stage_table(out, "trie-sums").join(parents, ["depth", "pa", "pb"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
