"""Line dedup: a segment-partition edit join over the lines of all documents.

A line of at least ``MIN_BYTES`` bytes goes if an earlier line (by document id, then
line number) is within ``THRESHOLD`` edits of it, counted in bytes of UTF-8.

1.  Every line is split into threshold + 1 segments; two lines within the threshold
    share one of them at a bounded shift.  Index entries are a line's own segments;
    probe entries are the substrings that could be a segment of an equally long or
    shorter line (key: length, segment number, substring).  Entries are hashed from
    prefix sums in numpy, without building substrings.
2.  Entries are dealt by key and sorted in Spark.  A pass over the sorted runs drops
    keys of single lines and finds, for every line, the earliest line of the run whose
    character-parity sketch leaves the threshold possible.  Memory holds one run.
3.  Those pairs are verified by banded bit-parallel edit distance.  Lines that aren't
    settled by their earliest partner meet all the other earlier ones of their keys.

Equal lines are handled by an aggregation on the line's hash, combined before the
shuffle.  Texts move only for candidate lines, found again through a bitmap sized by their
number, and for documents that lose lines; the others are never shuffled.

Defined results: null and empty texts have no line to remove; short lines stay; rows
with the same document id count as one document; rows without an id are left alone; an
empty table gives no rows.  ``dedup_lines`` drops a document that lost lines if nothing is
left of it, or nothing but short lines that the documents its lost lines repeat have, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolevec.llm.bits import bitmap, marked, maybe
from rolevec.llm.editdist import within
from rolevec.llm.ship import map_batches
from rolevec.llm.textkit import Lines, mix64, slices
from rolevec.session import stage_table, staging

THRESHOLD = 2
MIN_BYTES = 40
RUN_BLOCK = 256  # runs up to this size are compared step by step over all runs at once

U64 = np.uint64


def _segment(length: np.ndarray, parts: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of the k-th of ``parts`` nearly equal segments, the longer ones last."""
    base, extra = length // parts, length % parts
    return k * base + np.maximum(0, k - (parts - extra)), base + (k >= parts - extra)


def probe_shifts(threshold: int, k: int, delta: int) -> range:
    """Shifts at which segment k of a line shorter by ``delta`` can stand in the longer line."""
    left, right = k, threshold - k
    return range(max(-left, delta - right), min(left, delta + right) + 1)


def line_entries(lines: Lines, pick: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in ``pick``, key, is probe) of all entries of the picked lines."""
    start, size = lines.start[pick], lines.end[pick] - lines.start[pick]
    parts = threshold + 1
    who, keys, probe = [], [], []

    def add(at: np.ndarray, begin: np.ndarray, length: np.ndarray, target: np.ndarray, k: int, is_probe: int) -> None:
        tag = mix64(target.astype(U64) * U64(64) + U64(k + 1))
        who.append(at)
        keys.append(mix64(lines.hash(begin, begin + length) ^ tag))
        probe.append(np.full(len(at), is_probe, np.int8))

    everyone = np.arange(len(pick))
    for k in range(parts):
        p, n = _segment(size, parts, k)
        add(everyone, start + p, n, size, k, 0)
        for delta in range(threshold + 1):
            target = size - delta
            p, n = _segment(target, parts, k)
            for shift in probe_shifts(threshold, k, delta):
                if delta == 0 and shift == 0:
                    continue  # the index entry itself
                ok = np.flatnonzero((target >= 0) & (p + shift >= 0) & (p + shift + n <= size))
                add(ok, (start + p + shift)[ok], n[ok], target[ok], k, 1)
    return np.concatenate(who), np.concatenate(keys), np.concatenate(probe)


def parity_sketch(data: np.ndarray) -> np.ndarray:
    """Prefix XORs of one bit per byte value group: an edit changes two bits of a line's at most."""
    group = (mix64(np.arange(256).astype(U64)) & U64(31)).astype(np.uint32)
    return np.append(np.uint32(0), np.bitwise_xor.accumulate((np.uint32(1) << group)[data])) if len(data) else np.zeros(1, np.uint32)


def _eligible(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))


def _distinct(h: np.ndarray, doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Positions of the first occurrence (by document, line) of every hash."""
    order = np.lexsort((number, doc, h))
    new = np.ones(len(order), bool)
    new[1:] = h[order][1:] != h[order][:-1]
    return order[new]


def line_table(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """hash, doc_id, line_no of every line long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, _, data, off in slices(b.column(1)):
                lines = Lines(data, off)
                pick = np.flatnonzero(lines.end - lines.start >= min_bytes)
                h = lines.hash(lines.start[pick], lines.end[pick])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[lo + lines.row[pick]]), pa.array(lines.number[pick].astype(np.int32))],
                                                 names=["hash", "doc_id", "line_no"])

    return map_batches(_eligible(docs), run, "hash long, doc_id long, line_no int")


ENTRY = "key long, hash long, doc_id long, line_no int, sketch int, probe byte"


def entry_table(docs: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Index and probe entries; a line repeated within a slice enters once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for lo, _, data, off in slices(b.column(1)):
                lines = Lines(data, off)
                pick = np.flatnonzero(lines.end - lines.start >= min_bytes)
                if len(pick) == 0:
                    continue
                h, doc = lines.hash(lines.start[pick], lines.end[pick]), ids[lo + lines.row[pick]]
                own = _distinct(h, doc, lines.number[pick])
                pick, h, doc = pick[own], h[own], doc[own]
                xors = parity_sketch(data)
                sketch = (xors[lines.end[pick]] ^ xors[lines.start[pick]]).view(np.int32)
                who, key, probe = line_entries(lines, pick, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(h.view(np.int64)[who]), pa.array(doc[who]), pa.array(lines.number[pick].astype(np.int32)[who]),
                     pa.array(sketch[who]), pa.array(probe)], names=["key", "hash", "doc_id", "line_no", "sketch", "probe"])

    return map_batches(_eligible(docs), run, ENTRY)


def _partners(run_id: np.ndarray, sketch: np.ndarray, probe: np.ndarray, limit: int) -> np.ndarray:
    """For rows sorted by (run, document, line): the earliest possible partner within the run, or -1."""
    n = len(run_id)
    out = np.full(n, -1, np.int64)
    first = np.searchsorted(run_id, run_id)
    size = np.searchsorted(run_id, run_id, side="right") - first
    small = size <= RUN_BLOCK
    for d in range(1, int(size[small].max(initial=1))):
        at = np.flatnonzero(small & (np.arange(n) - first >= d))
        ok = (np.bitwise_count(sketch[at] ^ sketch[at - d]) <= limit) & ((probe[at] & probe[at - d]) == 0)
        out[at[ok]] = at[ok] - d  # a larger step is an earlier line
    for a in np.unique(first[~small]).tolist():
        z = a + int(size[a])
        for m in range(a + 1, z):
            ok = (np.bitwise_count(sketch[a:m] ^ sketch[m]) <= limit) & ((probe[a:m] & probe[m]) == 0)
            k = int(ok.argmax())
            if ok[k]:
                out[m] = a + k
    return out


RUN = "key long, hash long, doc_id long, line_no int, sketch int, probe byte, partner long"


def candidate_runs(entries: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Entries of keys with at least one possible pair, each with its earliest possible
    partner's hash (null if none)."""
    names = ["key", "hash", "doc_id", "line_no", "sketch", "probe"]
    kinds = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int8)

    def settle(c: list[np.ndarray]) -> pa.RecordBatch | None:
        key, h, doc, line, sketch, probe = c
        order = np.lexsort((line, doc, h, key))
        k, x = key[order], h[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
        heads = np.flatnonzero(new)
        kind = np.minimum.reduceat(probe[order], heads)  # an index entry serves as a probe, too
        order = order[heads]
        # runs of at least two lines, by (key, document, line)
        again = np.lexsort((line[order], doc[order], key[order]))
        order, kind = order[again], kind[again]
        run_id = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
        many = np.bincount(run_id)[run_id] > 1
        order, kind, run_id = order[many], kind[many], run_id[many]
        if len(order) == 0:
            return None
        partner = _partners(run_id, sketch[order].view(np.uint32), kind, 2 * threshold)
        useful = np.isin(run_id, run_id[partner >= 0])
        if not useful.any():
            return None
        other = pa.array(h[order][np.maximum(partner, 0)][useful], pa.int64(), mask=(partner < 0)[useful])
        cols = [pa.array(v[order][useful]) for v in (key, h, doc, line, sketch)]
        return pa.RecordBatch.from_arrays([*cols, pa.array(kind[useful]), other], names=[*names, "partner"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, k) for k in kinds]
        for b in batches:
            c = [np.concatenate((x, b.column(j).to_numpy())) for j, x in enumerate(held)]
            cut = int(np.searchsorted(c[0], c[0][-1])) if len(c[0]) else 0  # the last key may go on
            held = [x[cut:] for x in c]
            if cut and (done := settle([x[:cut] for x in c])) is not None:
                yield done
        if len(held[0]) and (done := settle(held)) is not None:
            yield done

    dealt = entries.repartition("key").sortWithinPartitions("key")
    return map_batches(dealt, run, RUN)


def candidate_texts(docs: DataFrame, hashes: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """hash, line (bytes) of the lines whose hash is listed."""
    listed = stage_table(hashes.select("hash").distinct(), "line-hashes")
    bits = bitmap(listed, "hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, off in slices(b.column(0)):
                lines = Lines(data, off)
                pick = np.flatnonzero(lines.end - lines.start >= min_bytes)
                h = lines.hash(lines.start[pick], lines.end[pick])
                hit = marked(bits, h)
                h, first = np.unique(h[hit], return_index=True)
                pick = pick[hit][first]
                texts = [data[s:e].tobytes() for s, e in zip(lines.start[pick].tolist(), lines.end[pick].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(texts, pa.binary())], names=["hash", "line"])

    found = map_batches(_eligible(docs).select("text"), run, "hash long, line binary")
    return found.join(listed, "hash", "left_semi").dropDuplicates(["hash"])


def verified(pairs: DataFrame, texts: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The pairs (hash, partner) within the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (x.cast(pa.large_binary()) for x in (b.column(2), b.column(3)))
            data = np.concatenate([np.frombuffer(x.buffers()[2] or b"", np.uint8) for x in (a, c)])
            base = len(np.frombuffer(a.buffers()[2] or b"", np.uint8))
            spans = []
            for x, shift in ((a, 0), (c, base)):
                at = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
                spans.append((at[:-1] + shift, np.diff(at)))
            ok = within(data, spans[0], spans[1], threshold) <= threshold
            yield b.select(["hash", "partner"]).filter(pa.array(ok))

    first = pairs.join(texts.withColumnRenamed("line", "a"), "hash")
    both = first.join(texts.select(F.col("hash").alias("partner"), F.col("line").alias("b")), "partner")
    return map_batches(both.select("hash", "partner", "a", "b"), run, "hash long, partner long")


def near_lines(docs: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Hashes of lines that have an earlier, different line within the threshold, each with
    the hash of one such line."""
    runs = stage_table(candidate_runs(entry_table(docs, threshold, min_bytes), threshold), "line-runs")
    first = stage_table(runs.where("partner is not null").select("hash", "partner").distinct(), "line-pairs")
    texts = stage_table(candidate_texts(docs, runs, min_bytes), "line-texts")
    settled = stage_table(_one_partner(verified(first, texts, threshold)), "line-settled")
    # What its earliest partners don't settle meets all earlier lines of its keys.
    open_rows = runs.where("partner is not null").join(settled.select("hash"), "hash", "left_anti")
    m, u = open_rows.alias("m"), runs.alias("u")
    earlier = F.struct("u.doc_id", "u.line_no") < F.struct("m.doc_id", "m.line_no")
    possible = (F.bit_count(F.col("m.sketch").bitwiseXOR(F.col("u.sketch"))) <= 2 * threshold) & ((F.col("m.probe") == 0) | (F.col("u.probe") == 0))
    more = (m.join(u, (F.col("m.key") == F.col("u.key")) & earlier & possible).select(F.col("m.hash").alias("hash"), F.col("u.hash").alias("partner")).distinct()
            .join(first, ["hash", "partner"], "left_anti"))
    return stage_table(settled.unionByName(_one_partner(verified(more, texts, threshold))), "line-near", outlive=True)


def _one_partner(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("hash").agg(F.min("partner").alias("partner"))


def line_flags(docs: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES) -> tuple[DataFrame, DataFrame]:
    """All long lines (hash, doc_id, line_no), and the lines that occur again or have an
    earlier one within the threshold (hash, first place, near, partner's hash)."""
    lines = stage_table(line_table(docs, min_bytes), "lines")
    with staging(docs.sparkSession):  # entries, runs and texts of candidates go here
        near = near_lines(docs, threshold, min_bytes)
    near = near.withColumn("near", F.lit(True))
    first = lines.groupBy("hash").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("n"))
    return lines, stage_table(first.join(near, "hash", "left").where("n > 1 or near").select("hash", "first", F.coalesce("near", F.lit(False)).alias("near"), "partner"), "line-flags")


def _gone(lines: DataFrame, flags: DataFrame) -> DataFrame:
    return lines.join(flags, "hash").where(F.col("near") | (F.struct("doc_id", "line_no") != F.col("first")))


def removed_lines(docs: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, removed (line numbers, sorted) of the documents that lose lines."""
    with staging(docs.sparkSession):
        gone = _gone(*line_flags(docs, threshold, min_bytes))
        return stage_table(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed")), "removed-lines", outlive=True)


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: number of lines, how many go, and their numbers (from 0)."""
    n = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n_lines"))
    gone = removed_lines(docs)
    return base.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                                                    F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"))


def copies(left: DataFrame, docs: DataFrame, lines: DataFrame, flags: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Ids (``__copy``) of the documents of ``left`` (doc_id, left: the lines kept) of which
    nothing is left that the documents holding their removed lines don't have.

    A long line that is kept has no earlier equal.  For the others, a removed line stands
    in the document of its first place, or of the line it is within the threshold of;
    that one is earlier, so what it loses in turn stands in one still earlier."""
    short = left.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("left"))).alias("left"))
    short = stage_table(short.where(~F.exists("left", lambda x: F.octet_length(x) >= min_bytes)), "line-left")
    asked = short.select("doc_id", F.explode_outer(F.filter("left", lambda x: x.rlike(r"[\p{L}\p{N}]"))).alias("line"))
    gone = _gone(lines.join(short.select("doc_id"), "doc_id", "left_semi"), flags)
    ours = gone.select("doc_id", F.when(F.col("near"), F.col("partner")).alias("partner"), F.col("first.doc_id").alias("first")).distinct()
    wanted = ours.where("partner is not null").select("partner").distinct()
    places = lines.join(wanted, lines["hash"] == wanted["partner"], "left_semi").groupBy(F.col("hash").alias("partner")).agg(F.min("doc_id").alias("at"))
    holders = ours.select("doc_id", F.col("first").alias("holder")).unionByName(ours.join(places, "partner").select("doc_id", F.col("at").alias("holder")))
    holders = stage_table(holders.where("holder <> doc_id").distinct(), "line-holders")
    who = stage_table(holders.select("holder").distinct(), "line-holder-ids")
    texts = docs.select(F.col("doc_id").cast("long").alias("holder"), "text").where(maybe(bitmap(who, "holder"), F.col("holder")))  # no other text moves
    held = (texts.join(who, "holder", "left_semi")
            .select("holder", F.explode(F.array_distinct(F.filter(F.split("text", "\n", -1), lambda x: (F.octet_length(x) < min_bytes) & x.rlike(r"[\p{L}\p{N}]")))).alias("line")).distinct())
    found = asked.join(holders, "doc_id").join(held, ["holder", "line"], "left_semi").select("doc_id", "line").distinct()
    own = asked.where("line is not null").join(found, ["doc_id", "line"], "left_anti").select("doc_id").distinct()
    return short.select("doc_id").join(own, "doc_id", "left_anti").select(F.col("doc_id").alias("__copy"))


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Documents without their repeated lines.  Columns stay, ``n_chars`` follows the text.

    A document that lost lines is dropped if it is a copy by what is left (:func:`copies`).
    Documents that lose nothing pass through a scan; only the others meet the line numbers."""
    with staging(docs.sparkSession):
        lines, flags = line_flags(docs, threshold, min_bytes)
        removed = _gone(lines, flags).groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
        gone = stage_table(removed.select(F.col("doc_id").alias("__doc"), F.col("removed").alias("__removed")), "removed-lines")
        bits = bitmap(gone, "__doc")
        touched = maybe(bits, docs["doc_id"].cast("long"))
        kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__removed", i))
        met = docs.where(touched).join(gone, F.col("doc_id").cast("long") == F.col("__doc"), "left")
        cut = met.withColumn("__left", F.when(F.col("__removed").isNotNull(), F.coalesce(kept, F.array().cast("array<string>"))))
        cut = stage_table(cut.drop("__removed"), "cut-documents", outlive=True)
        left = cut.where("__left is not null").select(F.col("__doc").alias("doc_id"), F.col("__left").alias("left"))
        dropped = stage_table(copies(left, docs, lines, flags, min_bytes), "line-copies", outlive=True)
    lost = F.col("__left").isNotNull()
    out = cut.join(dropped, F.col("__doc") == F.col("__copy"), "left_anti").withColumn("text", F.when(lost, F.array_join("__left", "\n")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(lost, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return docs.where(~touched).unionByName(out.select(*docs.columns))
