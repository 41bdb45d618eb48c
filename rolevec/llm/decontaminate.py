"""Benchmark decontamination with an FM-index per shard of the corpus.

A shard is a bounded run of whole documents inside one task.  Its words become
symbols of the benchmark's vocabulary (anything else is a break), an FM-index is
built over them, every benchmark window is searched backwards through the
wavelet-tree ranks, occurrences are located from sampled suffix positions, and
the spans they cover are merged per document.  No row of the corpus is shuffled.

Defined results: a null, empty or word-less text has no words and no hits; an
item without words matches nothing; an item shorter than the window is one
window; repeated items all count; an empty benchmark or corpus gives zero hits
or zero rows.  Every row of the corpus is a document of its own, also if ids repeat or
are null; the number of blocks doesn't change any result.  Extra columns of either
table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolevec.llm.fmindex import FMIndex
from rolevec.llm.ship import map_batches
from rolevec.llm.textkit import Words, slices
from rolevec.session import stage_table

WINDOW = 10
SHARD_BYTES = 1 << 20  # text bytes of a shard (a longer document is one shard)
BLOCK_WORDS = 2_000_000  # benchmark words searched per pass over the corpus
ITEMS_SCHEMA = "item_id string, hashes binary"


class Patterns:
    """Distinct windows of a block of items, as symbols 1.. of its vocabulary."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int) -> None:
        self.window = window
        self.item_ids = [i for i, _ in items]
        parts, owner = [], []
        for k, (_, h) in enumerate(items):
            if len(h) == 0:
                continue
            width = min(window, len(h))
            got = np.lib.stride_tricks.sliding_window_view(h, width)
            block = np.zeros((len(got), window), np.uint64)
            block[:, window - width :] = got
            parts.append(np.concatenate((block, np.full((len(got), 1), width, np.uint64)), axis=1))
            owner.append(np.full(len(got), k))
        if parts:
            rows, which = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
            pair = np.unique(np.stack((which.ravel(), np.concatenate(owner)), axis=1), axis=0)
            self.lengths = rows[:, window].astype(np.int64)
            hashes = rows[:, :window]
            real = np.arange(window) >= (window - self.lengths)[:, None]
            self.vocabulary = np.unique(hashes[real])
            self.symbols = np.where(real, np.searchsorted(self.vocabulary, hashes) + 1, 0)
        else:
            pair = np.zeros((0, 2), np.int64)
            self.lengths, self.vocabulary = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            self.symbols = np.zeros((0, window), np.int64)
        self.owners = pair[:, 1]
        self.owner_at = np.searchsorted(pair[:, 0], np.arange(len(self.lengths) + 1))

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word position, pattern) of every occurrence within single rows of ``w``."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(w.hash) == 0 or len(self.lengths) == 0:
            return none
        at = np.minimum(np.searchsorted(self.vocabulary, w.hash), len(self.vocabulary) - 1)
        symbol = np.where(self.vocabulary[at] == w.hash, at + 1, 0)
        # Runs of known words within a row; shorter ones than any window can't match.
        begins = np.zeros(len(symbol), bool)
        begins[w.first[:-1][w.counts() > 0]] = True
        known = symbol > 0
        head = known & (begins | ~np.append(False, known[:-1]))
        last = known & np.append(begins[1:] | ~known[1:], True)
        lo, hi = np.flatnonzero(head), np.flatnonzero(last) + 1
        long = hi - lo >= self.lengths.min()
        lo, hi = lo[long], hi[long]
        if len(lo) == 0:
            return none
        sizes = hi - lo + 1  # with its break
        ends = np.cumsum(sizes)
        position = np.arange(ends[-1]) - np.repeat(ends - sizes - lo, sizes)
        text = symbol[np.minimum(position, len(symbol) - 1)]
        text[ends - 1] = 0
        index = FMIndex(text, len(self.vocabulary) + 1)
        first, beyond = index.search(self.symbols, self.lengths)
        n = beyond - first
        total = int(n.sum())
        if total == 0:
            return none
        pattern = np.repeat(np.arange(len(n)), n)
        rows = np.repeat(first - np.cumsum(n) + n, n) + np.arange(total)
        return position[index.locate(rows)], pattern


def _merged(w: Words, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per word: is it inside an occurrence."""
    edge = np.bincount(at, minlength=len(w.hash) + 1) - np.bincount(at + lengths, minlength=len(w.hash) + 1)
    return np.cumsum(edge)[: len(w.hash)] > 0


def _spans(hit: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray]:
    begins = np.zeros(len(hit), bool)
    begins[w.first[:-1][w.counts() > 0]] = True
    head = hit & (begins | ~np.append(False, hit[:-1]))
    last = hit & np.append(begins[1:] | ~hit[1:], True)
    return np.flatnonzero(head), np.flatnonzero(last) + 1


def item_words(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per item with the hashes of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, _, data, off in slices(b.column(1)):
                w = Words(data, off)
                out += [w.hash[a:z].tobytes() for a, z in zip(w.first[:-1], w.first[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["item_id", "hashes"])

    return map_batches(benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")), run, ITEMS_SCHEMA)


def pattern_blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
                   id_col: str = "item_id", text_col: str = "text") -> Iterator[Patterns]:
    """The benchmark's windows in blocks of bounded size, one block in memory at a time.

    Usually one block.  A larger benchmark is cut by a hash of the item id, and the
    corpus is searched once per block.  One item alone may exceed the bound."""
    items = item_words(benchmark, id_col, text_col)
    total = items.agg(F.sum(F.length("hashes") / 8)).first()[0] or 0
    n = max(1, -(-int(total) // block_words))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k)
        rows = [(r["item_id"] or "", np.frombuffer(r["hashes"], np.uint64)) for r in part.collect()]
        yield Patterns(rows, window)


def _scan(patterns: Patterns):
    """Task: doc_id, n_words, spans (word and byte), items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in slices(b.column(1), SHARD_BYTES):
                w = Words(data, off)
                at, pattern = patterns.find(w)
                hit = _merged(w, at, patterns.lengths[pattern])
                first, beyond = _spans(hit, w)
                rows = w.rows()
                # one entry per (row, item)
                n_own = patterns.owner_at[pattern + 1] - patterns.owner_at[pattern]
                entry = np.repeat(patterns.owner_at[pattern] - np.cumsum(n_own) + n_own, n_own) + np.arange(int(n_own.sum()))
                pairs = np.unique(np.stack((np.repeat(rows[at] if len(at) else at, n_own), patterns.owners[entry]), axis=1), axis=0)
                spans, items = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
                for a, z in zip(first.tolist(), beyond.tolist()):
                    r = int(rows[a])
                    spans[r].append({"first": a - int(w.first[r]), "last": z - 1 - int(w.first[r]),
                                     "byte_start": int(w.start[a] - off[r]), "byte_end": int(w.end[z - 1] - off[r])})
                for r, k in pairs.tolist():
                    items[r].append(patterns.item_ids[k])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(w.counts(), pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64())]))),
                     pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "n_words", "spans", "items"])

    return run


SPAN = "struct<first: bigint, last: bigint, byte_start: bigint, byte_end: bigint>"
SCAN_SCHEMA = f"doc_id bigint, n_words bigint, spans array<{SPAN}>, items array<string>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``n_words``, merged ``spans`` (word positions, inclusive, and byte
    offsets of the text), ``items`` whose windows occur, ``n_hit`` words inside any."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = pattern_blocks(benchmark, window, block_words)
    one, more = next(blocks), next(blocks, None)
    if more is None:
        out = map_batches(source, _scan(one), SCAN_SCHEMA)
    else:  # spans of several blocks: merge what touches, row by row
        rows = stage_table(source.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
        out = (_block_hits(rows, [one, more], blocks).groupBy("row")
               .agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
                    F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
               .withColumn("spans", _merge_spans(F.col("spans"))))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def _block_hits(rows: DataFrame, first: list[Patterns], more: Iterator[Patterns]) -> DataFrame:
    """row, doc_id, n_words, spans, items of every row and block; ``rows`` (row, doc_id,
    text) is a written table, so that a row has one number in all scans."""
    out = None
    for patterns in chain(first, more):
        hits = map_batches(rows.select("row", "text"), _scan(patterns), SCAN_SCHEMA).withColumnRenamed("doc_id", "row")
        hits = stage_table(hits, "decontaminate-hits")
        out = hits if out is None else out.unionByName(hits)
    return out.join(rows.select("row", "doc_id"), "row")


def _merge_spans(spans):
    """Sorted spans with overlapping and adjacent ones joined."""
    empty = F.array().cast(f"array<{SPAN}>")

    def add(done, s):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"),
                          last["byte_start"].alias("byte_start"), F.greatest(last["byte_end"], s["byte_end"]).alias("byte_end"))
        return F.when((F.size(done) > 0) & (s["first"] <= last["last"] + 1),
                      F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
                      ).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, add)


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest of :func:`find_contamination` (no items: the hash of the empty string)."""
    f = find_contamination(docs, benchmark, window)
    return f.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def sha_of(items: list[str]) -> str:
    """The digest of a list of item ids, restated for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents with the merged spans cut out (a newline stays in their place), until no
    window is left.  Columns stay; ``n_chars`` follows the text if there is one.  A
    document of which no word is left is dropped; one without hits is unchanged."""
    blocks = pattern_blocks(benchmark, window, block_words)
    patterns, more = next(blocks), next(blocks, None)
    if more is not None:
        return _remove_blocks(docs, benchmark, window, text_col, block_words)
    names = docs.columns
    k = names.index(text_col)
    n_chars = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(k)
            changed: dict[int, str | None] = {}
            for lo, _, data, off in slices(column, SHARD_BYTES):
                w = Words(data, off)
                at, pattern = patterns.find(w)
                if len(at) == 0:
                    continue
                for r in np.unique(w.rows()[at]).tolist():
                    changed[lo + r] = clean_text(bytes(data[off[r] : off[r + 1]]), patterns)
            if changed:
                rows = sorted(changed)
                mask = np.zeros(len(b), bool)
                mask[rows] = True
                columns = list(b.columns)
                columns[k] = pc.replace_with_mask(column, pa.array(mask), pa.array([changed[r] for r in rows], column.type))
                if n_chars is not None:
                    sizes = [None if changed[r] is None else len(changed[r]) for r in rows]
                    columns[n_chars] = pc.replace_with_mask(b.column(n_chars), pa.array(mask), pa.array(sizes, b.column(n_chars).type))
                gone = np.zeros(len(b), bool)
                gone[[r for r in rows if changed[r] is None]] = True
                b = pa.RecordBatch.from_arrays(columns, names=b.schema.names).filter(pa.array(~gone))
            yield b

    return map_batches(docs, run, docs.schema)


def _remove_blocks(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, block_words: int) -> DataFrame:
    """Removal with several blocks: a pass searches all blocks and cuts their united spans
    at once; the texts that it changed go through another pass."""
    numbered = stage_table(docs.withColumn("__row", F.monotonically_increasing_id()), "decontaminate-rows")
    texts = numbered.select(F.col("__row").alias("row"), F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = []  # per pass, the changed rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = text.encode("utf-8")
                edges = [0, *(x for s in spans for x in (s["byte_start"], s["byte_end"])), len(raw)]
                raw = b"\n".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2]))
                some = len(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hash) > 0
                out.append(raw.decode("utf-8") if some else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["row", "text"])

    while True:
        hits = _block_hits(texts, [], pattern_blocks(benchmark, window, block_words)).where(F.size("spans") > 0)
        spans = hits.groupBy("row").agg(_merge_spans(F.flatten(F.collect_list("spans"))).alias("spans"))
        changed = stage_table(map_batches(texts.join(spans, "row").select("row", "text", "spans"), run, "row long, text string").withColumn("turn", F.lit(len(cut))), "decontaminate-cut")
        if changed.isEmpty():
            break
        cut.append(changed)
        texts = changed.where(F.col("text").isNotNull()).select("row", F.lit(None).cast("long").alias("doc_id"), "text")
    if not cut:
        return numbered.select(*docs.columns)
    last = cut[0]
    for more in cut[1:]:
        last = last.unionByName(more)
    last = last.groupBy("row").agg(F.max_by(F.struct("text"), "turn").alias("__new")).withColumnRenamed("row", "__cut")
    joined = numbered.join(last, numbered["__row"] == last["__cut"], "left").where(F.col("__cut").isNull() | F.col("__new.text").isNotNull())
    new = {text_col: F.col("__new.text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("__new.text").cast(docs.schema["n_chars"].dataType)
    return joined.select(*(F.when(F.col("__cut").isNull(), F.col(c)).otherwise(new[c]).alias(c) if c in new else F.col(c) for c in docs.columns))


def clean_text(raw: bytes, patterns: Patterns) -> str | None:
    """The text without any occurrence of a window; None if no word is left."""
    while True:
        w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        if len(w.hash) == 0:
            return None
        at, pattern = patterns.find(w)
        if len(at) == 0:
            return raw.decode("utf-8")
        first, beyond = _spans(_merged(w, at, patterns.lengths[pattern]), w)
        edges = [0, *np.stack((w.start[first], w.end[beyond - 1]), axis=1).ravel().tolist(), len(raw)]
        raw = b"\n".join(raw[a:z] for a, z in zip(edges[::2], edges[1::2]))
