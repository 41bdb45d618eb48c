"""Best-fit packing by the sum-of-squares rule.

Documents are tokenised and cut so that only their first piece may be shorter
than a sequence; full pieces are sequences of their own.  Short pieces are packed
by counts: an item of size s goes into the open bin (or a new one) for which the
sum over residual gaps of the squared number of open bins becomes smallest.

Items are dealt at random (by a hash of the document) into shards of bounded
size, each packed by one task, so neither a task nor the driver sees all of them;
a shard leaves a few bins partly filled, a loss that shrinks with its size.

Defined results: a null or empty text is the closing token alone; equal texts are
separate items; a null id stays null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolevec.llm.ship import map_batches, ship
from rolevec.llm.textkit import mix64
from rolevec.session import stage_table

SEQUENCE = 1024
CLOSING = 2  # id that ends every document
SHARD_ITEMS = 40_000
BIG = 0.4  # share of a sequence above which items go first, in descending order


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of a text by the vocabulary file, as little-endian unsigned 32-bit bytes.

    Texts of code points below U+0800 without a special token's string take a faster
    library with the same merge ranks and split pattern; all others the vocabulary's own."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        self.path, self.tokenizer, self.fast = path, None, None
        self.special = [t["content"] for t in json.loads(Path(path).read_text())["added_tokens"]]
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            with ranks.open("rb") as f:
                merge = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or (not text.isascii() and max(text) >= "\u0800") or any(s in text for s in self.special):
            if self.tokenizer is None:  # loaded when a text needs it
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.path)
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text).astype("<u4").tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The task's encoder, kept between batches of a worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, size: int = SEQUENCE, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece.  Only documents longer than ``size`` are cut; the first piece takes
    what is left over, the others are full."""
    path = vocabulary or default_vocabulary()
    closing = np.array([CLOSING], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                raw = enc.encode(text.as_py() or "") + closing
                n = len(raw) // 4
                start, end, k = 0, n % size or size, 0
                end = min(end, n)
                while start < n:
                    rows.append((doc, k, start, end - start, zlib.crc32(raw[4 * start : 4 * end])))
                    start, end, k = end, end + size, k + 1
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, PIECES)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every item, in the given order.

    ``open_bins[g]`` counts bins with gap g; moving one from gap g to g - s changes the sum
    of squares by 2 (open[g - s] - open[g]) + 2, a new bin by 2 open[capacity - s] + 1, and a
    bin that becomes full leaves the sum.  Ties take the smallest gap, then a new bin."""
    count = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for k, s in enumerate(sizes.tolist()):
        if not 0 < s <= capacity:
            raise ValueError(f"item of size {s} for bins of {capacity}")
        if s == capacity:
            bins[k], offsets[k], used = used, 0, used + 1
            continue
        # Change of the sum of squares for each gap g = s .. capacity - 1.
        change = 2 * (count[: capacity - s] - count[s:capacity]) + 2
        change[0] = 1 - 2 * count[s]
        change[count[s:capacity] == 0] = np.iinfo(np.int64).max
        g = int(change.argmin())
        if change[g] <= 2 * count[capacity - s] + 1:
            g += s
            b = stacks[g].pop()
            count[g] -= 1
        else:
            g, b, used = capacity, used, used + 1
        bins[k], offsets[k] = b, capacity - g
        if g > s:
            stacks[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, size: int = SEQUENCE, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (read more than once: a written table)."""
    short = pieces.where(F.col("length") < size)
    shards = max(1, -(-short.count() // shard_items))

    def place(t: pa.Table) -> pa.Table:
        # Arrow keeps 64-bit ids as they are, also beside null ones
        sizes = t.column("length").to_numpy()
        # Big items first, largest to smallest; the others in random order even out the gaps.
        chance = mix64(t.column("doc_id").fill_null(0).to_numpy().view(np.uint64))
        seq = np.lexsort((t.column("ids_crc32").to_numpy(), chance, np.where(sizes > BIG * size, -sizes, 0)))
        bins, offsets = sum_of_squares(sizes[seq], size)
        out = t.select(["doc_id", "piece", "start", "length", "ids_crc32"]).take(pa.array(seq))
        return out.append_column("sequence_id", pa.array(bins * shards + t.column("shard")[0].as_py())).append_column("offset", pa.array(offsets))

    schema = PIECES + ", sequence_id long, offset long"
    dealt = short.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    ship(pieces.sparkSession)
    packed = dealt.groupBy("shard").applyInArrow(place, schema)
    # A full piece is a sequence of its own, numbered below zero.
    full = pieces.where(F.col("length") == size).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, size: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """Pieces of all documents with their place in a sequence; texts are tokenised once."""
    return pack(stage_table(token_pieces(docs, size, vocabulary), "pieces"), size)
