"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct 3-word shingles (64-bit hashes of the words).
Equal sets are one class, found by an aggregation on a 128-bit set hash; only one
document of a class takes part below.

1.  Tokens are ordered by hash.  A slightly extended prefix of every set is counted over
    all documents; tokens in more than ``RARE`` of them are the frequent class, marked in
    a bitmap sized by their number (a collision demotes a rare token everywhere alike).  In the
    join's order frequent tokens come last.
2.  Rare prefix tokens are indexed singly.  The prefix is extended by ``SHARED`` - 1, so
    that linked documents share at least ``SHARED`` of them; pairs are counted per key
    run and aggregated.
3.  A document with too few rare tokens for that (the members of large groups of near
    copies) also indexes k = 2 token combinations: neighbours in the order within a
    prefix of 2 D + 2 tokens, D being the most tokens by which linked sets can differ.
    By counting, linked sets have an unbroken combination in common.  Documents that
    share combinations form groups, compared in blocks of bounded size.
4.  Candidates are verified on the whole sets, by exact intersection sizes.

Blocks return the spanning links of what they find, so a group's links aren't expanded;
links between different texts are all verified or implied.

Defined results: no words or null text: an empty set, linked with nothing, its own
component; fewer words than a shingle: the whole sequence is one token; every row gives a
row; a row without an id has the size of its set, no component, and links nothing; rows
with the same id are one document of the links, each with the size of its own set, and
should hold the same text; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolevec.llm.bits import bitmap, marked, maybe
from rolevec.llm.graph import components, local_roots
from rolevec.llm.ship import map_batches, map_groups
from rolevec.llm.textkit import Words, mix64, slices
from rolevec.session import stage_table, staging

SHINGLE = 3
PERCENT = 90
RARE = 24  # a token in more prefixes than this is frequent
SHARED = 3
COUNT_ROUNDS = 2  # of the frequent class; more rounds only save work, results are the same
BLOCK = 256  # documents of a block
COLUMNS = 4096  # tokens of a dense slab

U64 = np.uint64


def overlap(n, m, percent: int = PERCENT):
    """Smallest intersection of linked sets of these sizes."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_size(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Linked sets share a token within this many of the first."""
    smallest = -(-percent * n // 100)
    return n - overlap(n, smallest, percent) + 1


def most_apart(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Most tokens in the symmetric difference with any linked set."""
    largest = 100 * n // percent
    return np.maximum(0, n + largest - 2 * overlap(n, largest, percent))


def token_sets(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct tokens of all rows, offsets per row)."""
    w = Words(data, off, "space")
    n = len(w.hash)
    if n == 0:
        return np.zeros(0, U64), np.zeros(len(off), np.int64)
    roll = np.zeros(n, U64)
    for j in range(k):
        part = mix64(w.hash + U64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        roll[: n - j] += part[j:]
    roll = mix64(roll)
    out = []
    sizes = np.zeros(len(off) - 1, np.int64)
    for r, (a, z) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist())):
        if z == a:
            continue
        if z - a < k:  # the sequence as a whole, apart from any shingle
            got = np.array([z - a], U64)
            for j in range(a, z):
                got = mix64(got * U64(3) + w.hash[j])
        else:
            got = np.sort(roll[a : z - k + 1])
            got = got[np.append(True, got[1:] != got[:-1])]
        sizes[r] = len(got)
        out.append(got)
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.append(0, np.cumsum(sizes))


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))


def set_table(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n, a, b (set hash), head (the first tokens by hash, as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in slices(batch.column(1)):
                tokens, at = token_sets(data, off, k)
                n = np.diff(at)
                sums = [np.append(U64(0), np.cumsum(x, dtype=U64)) for x in (tokens, mix64(tokens ^ U64(0x5851F42D4C957F2D)))]
                p = prefix_size(n, percent)
                head = np.minimum(n, p + SHARED - 1 + np.maximum(4, p // 2))
                heads = [tokens[s : s + c].tobytes() for s, c in zip(at[:-1].tolist(), head.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), *(pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64)) for s in sums), pa.array(heads, pa.binary())],
                                                 names=["doc_id", "n", "a", "b", "head"])

    return map_batches(_source(docs), run, "doc_id long, n long, a long, b long, head binary")


def whole_sets(docs: DataFrame, wanted: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, tokens (bytes, sorted by hash) of the wanted documents, found again by a scan."""
    bits = bitmap(wanted, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(marked(bits, batch.column(0).to_numpy())))
            for lo, hi, data, off in slices(batch.column(1)):
                tokens, at = token_sets(data, off, k)
                sets = [tokens[s:e].tobytes() for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["doc_id", "tokens"])

    found = map_batches(_source(docs).where("doc_id is not null"), run, "doc_id long, tokens binary")
    return found.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])


def frequent_tokens(lists: DataFrame, column: str, rare: int = RARE) -> DataFrame:
    """The tokens (token) in more than ``rare`` of the lists, counted over all of them."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = b"".join(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(joined, np.int64))], names=["token"])

    counts = map_batches(lists.select(column), packed, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return stage_table(counts.where(F.col("n") > rare).select("token"), "frequent-tokens")


ENTRY = "key long, doc_id long, n int, need int"


def rare_entries(heads: DataFrame, frequent: np.ndarray, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Single-token entries of documents whose head holds enough rare tokens; ids of the others."""

    def pick(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = batch.column(1).to_numpy()
        column = batch.column(2).cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 8
        tokens = np.frombuffer(column.buffers()[2] or b"", U64)[at[0] : at[-1]]
        row = np.repeat(np.arange(len(n)), np.diff(at))
        free = ~marked(frequent, tokens)
        tokens, row = tokens[free], row[free]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        want = prefix_size(n, percent) + SHARED - 1
        enough = np.bincount(row, minlength=len(n)) >= want
        take = (rank < want[row]) & enough[row]
        return tokens[take], row[take], n, enough

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                tokens, row, n, _ = pick(batch)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(batch.column(0).to_numpy()[row]), pa.array(n[row].astype(np.int32)),
                                                  pa.array(np.full(len(row), SHARED, np.int32))], names=["key", "doc_id", "n", "need"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                enough = pick(batch)[3]
                yield batch.select(["doc_id"]).filter(pa.array(~enough))

    source = heads.select("doc_id", "n", "head")
    return map_batches(source, entries, ENTRY), map_batches(source, others, "doc_id long")


def dense_entries(sets: DataFrame, frequent: np.ndarray, combinations: bool, percent: int = PERCENT) -> DataFrame:
    """From whole sets: the rare prefix tokens singly, or the combinations of documents whose
    prefix reaches into the frequent class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = np.frombuffer(raw, U64)
                n = len(tokens)
                p = int(prefix_size(np.array(n), percent))
                often = marked(frequent, tokens)
                free = tokens[~often]
                if combinations:
                    if len(free) >= p:
                        continue
                    q = 2 * int(most_apart(np.array(n), percent)) + 2
                    order = np.concatenate((free, tokens[often]))[:q]
                    keys = mix64(order[:-1] * U64(0x9E3779B97F4A7C15) + mix64(order[1:] + U64(1)))
                else:
                    keys = free[: p + SHARED - 1]
                need = SHARED if len(free) >= p + SHARED - 1 else 1
                for column, v in zip(out, (keys.view(np.int64), np.full(len(keys), doc), np.full(len(keys), n, np.int32), np.full(len(keys), need, np.int32))):
                    column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["key", "doc_id", "n", "need"])

    return map_batches(sets, run, ENTRY)


def _runs(entries: DataFrame, settle, schema: str) -> DataFrame:
    """Apply ``settle(key, doc, n, need)`` to whole runs of equal keys, dealt and sorted by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            c = [batch.column(j).to_numpy() for j in range(4)]
            c = c if held is None else [np.concatenate(x) for x in zip(held, c)]
            cut = int(np.searchsorted(c[0], c[0][-1])) if len(c[0]) else 0
            held = [x[cut:] for x in c]
            if cut:
                yield from settle(*(x[:cut] for x in c))
        if held is not None and len(held[0]):
            yield from settle(*held)

    return map_batches(entries.repartition("key").sortWithinPartitions("key", "n", "doc_id"), run, schema)


def run_pairs(entries: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a < b) that share enough rare keys."""

    def settle(key, doc, n, need):
        first = np.searchsorted(key, key)
        at = np.arange(len(key))
        for d in range(1, int((at - first).max(initial=0)) + 1):
            hi = np.flatnonzero(at - first >= d)
            lo = hi - d
            ok = (100 * n[lo].astype(np.int64) >= percent * n[hi].astype(np.int64)) & (doc[lo] != doc[hi])
            hi, lo = hi[ok], lo[ok]
            if len(hi):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(doc[lo], doc[hi])), pa.array(np.maximum(doc[lo], doc[hi])), pa.array(np.minimum(need[lo], need[hi]))], names=["a", "b", "need"])

    pairs = _runs(entries, settle, "a long, b long, need int")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("need").alias("need")).where("shared >= need").select("a", "b")


def run_stars(entries: DataFrame) -> DataFrame:
    """Links from the first document of every run to the others (groups, not results)."""

    def settle(key, doc, n, need):
        first = np.searchsorted(key, key)
        a, b = doc[first], doc
        a, b = local_roots(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])

    return _runs(entries, settle, "a long, b long")


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Exact intersection sizes of all pairs of two lists of sorted sets."""
    sizes = [np.array([len(x) for x in s], np.int64) for s in (left, right)]
    flat = [np.concatenate(s) if s else np.zeros(0, U64) for s in (left, right)]
    shared = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.float32)
    rows = [np.repeat(np.arange(len(s)), s) for s in sizes]
    at = [np.searchsorted(shared, f) for f in flat]
    hit = [(a < len(shared)) & (shared[np.minimum(a, max(len(shared) - 1, 0))] == f) if len(shared) else np.zeros(len(f), bool) for a, f in zip(at, flat)]
    rows, at = [r[h] for r, h in zip(rows, hit)], [a[h] for a, h in zip(at, hit)]
    for c in range(0, len(shared), COLUMNS):
        slab = []
        for r, a, s in zip(rows, at, sizes):
            of = (a >= c) & (a < c + COLUMNS)
            m = np.zeros((len(s), min(COLUMNS, len(shared) - c)), np.float32)
            m[r[of], a[of] - c] = 1
            slab.append(m)
        out += slab[0] @ slab[1].T
    return out.astype(np.int64)


def linked(i: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * i >= percent * (n + m - i)


def pair_links(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                both = np.sort(np.concatenate((x, y)))
                i = int((both[1:] == both[:-1]).sum())
                ok.append(100 * i >= percent * (len(both) - i))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    first = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), "a")
    both = first.join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y")), "b")
    return map_batches(both.select("a", "b", "x", "y"), run, "a long, b long")


def group_links(groups: DataFrame, sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Spanning links within groups (node, component), compared in pairs of blocks.

    Sets are bucketed by size, so that linked ones lie in the same or in neighbouring
    buckets; a bucket is cut into blocks by a hash; a set goes to the block pairs it is in."""
    size = F.octet_length("tokens") / 8
    bucket = F.floor(F.log(size) / math.log(100 / percent) + 1e-9).cast("long")
    base = sets.select("doc_id", bucket.alias("bucket")).join(groups.select(F.col("node").alias("doc_id"), F.col("component").alias("grp")), "doc_id")
    base = stage_table(base, "group-members")
    count = base.groupBy("grp", "bucket").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    count = stage_table(count, "group-sizes")
    up = count.select("grp", (F.col("bucket") - 1).alias("bucket"), F.col("blocks").alias("above"))
    down = count.select("grp", (F.col("bucket") + 1).alias("bucket"), F.col("blocks").alias("below"))
    known = stage_table(base.join(count, ["grp", "bucket"]).join(up, ["grp", "bucket"], "left").join(down, ["grp", "bucket"], "left"), "group-blocks")
    known = sets.select("doc_id", "tokens").join(known, "doc_id")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    none = F.array().cast("array<struct<lo: bigint, i: int, j: int, side: int>>")

    def cells(lo, i, j, side):
        return F.struct(lo.cast("long").alias("lo"), i.cast("int").alias("i"), j.cast("int").alias("j"), side.alias("side"))

    # Cells (i, j): within the bucket i <= j; across to the next bucket j is stored as -1 - j.
    within = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: cells(F.col("bucket"), F.least(own, k), F.greatest(own, k), F.when(own <= k, F.lit(0)).otherwise(F.lit(1))))
    over = F.when(F.col("above").isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda k: cells(F.col("bucket"), own, -1 - k, F.lit(0))))
    under = F.when(F.col("below").isNull(), none).otherwise(F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda k: cells(F.col("bucket") - 1, k, -1 - own, F.lit(1))))
    dealt = known.select("grp", "doc_id", "tokens", F.explode(F.concat(within, over, under)).alias("cell")).select("grp", "cell.*", "doc_id", "tokens")

    def compare(pdf):
        sides = [pdf[pdf["side"] == s] for s in (0, 1)]
        if len(sides[1]) == 0 and int(pdf["j"].iloc[0]) == int(pdf["i"].iloc[0]):
            sides[1] = sides[0]
        docs = [s["doc_id"].to_numpy() for s in sides]
        sets = [[np.frombuffer(t, U64) for t in s["tokens"]] for s in sides]
        n = [np.array([len(x) for x in s], np.int64) for s in sets]
        if not len(docs[0]) or not len(docs[1]):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        x, y = np.nonzero(linked(intersections(*sets), n[0][:, None], n[1][None, :], percent))
        a, b = docs[0][x], docs[1][y]
        a, b = a[a != b], b[docs[0][x] != b]
        node, root = local_roots(a, b)
        return pd.DataFrame({"a": root[node != root], "b": node[node != root]})

    return map_groups(dealt, ["grp", "lo", "i", "j"], compare, "a long, b long")


def class_heads(table: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, head of one document per set.  Sets too small to differ from a linked one take no part."""
    part = F.col("n") + F.floor(100 * F.col("n") / percent) - 2 * F.ceil(percent * (F.col("n") + F.floor(100 * F.col("n") / percent)) / (100 + percent)) > 0
    reps = classes.where("rep is not null").select(F.col("rep").alias("doc_id")).distinct()
    return table.where(part).join(reps, "doc_id", "left_semi").select("doc_id", "n", "head").dropDuplicates(["doc_id"])


def set_links(docs: DataFrame, heads: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that span the components of different sets.  A whole set is written at
    most once for its group and once for its pairs."""
    spark = docs.sparkSession
    often = frequent_tokens(heads, "head")
    frequent, dense = bitmap(often, "token"), None
    for _ in range(COUNT_ROUNDS):
        singles, others = rare_entries(heads, frequent, percent)
        more = stage_table(others if dense is None else others.join(dense.select("doc_id"), "doc_id", "left_anti"), "dense-documents")
        if dense is not None and more.isEmpty():
            break
        found = stage_table(whole_sets(docs, more, k), "dense-sets")
        # Documents with many frequent tokens index tokens beyond their heads: those count, too.
        often = often.unionByName(frequent_tokens(found, "tokens"))
        frequent = bitmap(often, "token")
        dense = found if dense is None else dense.unionByName(found)
    else:
        singles, others = rare_entries(heads, frequent, percent)
        last = stage_table(others.join(dense.select("doc_id"), "doc_id", "left_anti"), "dense-documents")
        dense = dense.unionByName(stage_table(whole_sets(docs, last, k), "dense-sets"))
    pairs = stage_table(run_pairs(singles.unionByName(dense_entries(dense, frequent, False, percent)), percent), "pairs")
    with staging(spark):
        wanted = stage_table(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "pair-documents")
        near = stage_table(pair_links(pairs, stage_table(whole_sets(docs, wanted, k), "pair-sets"), percent), "pair-links", outlive=True)
    with staging(spark):
        groups = components(run_stars(dense_entries(dense, frequent, True, percent)))
        linked_groups = stage_table(group_links(groups, dense, percent), "group-links", outlive=True)
    return near.unionByName(linked_groups)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) of every document.

    Working tables go as soon as their step is done; one small table, a row per document, stays."""
    spark = docs.sparkSession
    with staging(spark):
        with staging(spark):  # all heads, then those of one document per set
            table = stage_table(set_table(docs, k, percent), "sets")
            ids = stage_table(table.drop("head"), "set-ids", outlive=True)
            classes = stage_table(ids.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep")), "set-classes", outlive=True)
            heads = stage_table(class_heads(table, classes, percent), "set-heads", outlive=True)
        with staging(spark):
            links = stage_table(set_links(docs, heads, k, percent), "set-links", outlive=True)
        comps = components(links)
        named = classes.join(comps, classes["rep"] == comps["node"], "left").select("n", "a", "b", F.coalesce("component", "rep").alias("component"))
        out = ids.join(named, ["n", "a", "b"], "left")
        found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
        return stage_table(out.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id")), "near-duplicates", outlive=True)


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Documents that are the smallest id of their component; columns unchanged.  Rows
    without an id stay.  Texts aren't shuffled unless the ids to leave out are many."""
    found = near_duplicates(docs, k, percent)
    gone = stage_table(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "near-copies")
    return without(docs, gone)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose id isn't listed (``__gone``).  A scan parts those that can't be."""
    listed = maybe(bitmap(gone, "__gone"), docs["doc_id"].cast("long"))
    return docs.where(~listed).unionByName(docs.where(listed).join(gone, docs["doc_id"] == gone["__gone"], "left_anti"))
