"""WARC archives of Zstandard frames: one frame per record, dictionary up front.

File layout (the public "WARC with Zstandard" convention): a leading skippable
frame (magic 0x184D2A5D) holds the dictionary, itself possibly a Zstandard frame;
every record then is one frame compressed with it.  The reader loads the
dictionary, decodes frame by frame, and validates version line, header fields,
block length, trailing CRLFs and the payload digest.

Spark writes an archive per partition of the pages and reads archives as binary
rows through its own file reader, so they may lie in any store it knows.  Equal
payloads of at least ``min_bytes`` are kept once, by the largest page id; the other
records are revisits that refer to it.  That choice is an aggregation on (digest,
length), so a hot payload is combined before the shuffle, and pages join it back.

Archives of other writers are read, too: their dictionary may be a trained one or raw
content, versions 1.0 and 1.1 are known, and what a record doesn't say is null or computed.
The payload of an HTTP message's record is its whole block.

Defined results: null html is an empty payload; a null url an empty target URI; a null page
id is left out of the header and read back as null (equal payloads without ids are all
responses); repeated rows are separate records; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolevec.llm.ship import map_batches
from rolevec.session import scratch_path, stage_table

MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 8 << 20  # payload bytes after which a task closes an archive
DICT_BYTES = 16 << 10
FEED = 16 << 10  # bytes given to the decoder at once
DICT_SAMPLES = 16  # payloads that shape the shared dictionary (a bounded sample)
LEVEL = 3

#: Fixed values of the format.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
VERSIONS = (VERSION, b"WARC/1.0")
EPOCH = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format."""


def record_bytes(kind: str, uri: str, payload: bytes, digest: str, page_id: int | None, refers_to: int | None) -> bytes:
    """One record: header block, empty line, block, two CRLFs.  A revisit's block is empty."""
    block = payload if kind == "response" else b""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"),
              ("WARC-Date", EPOCH), ("WARC-Target-URI", _clean(uri)), *([("WARC-Page-ID", str(page_id))] if page_id is not None else []),
              ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"),
              ("WARC-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", str(refers_to))]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return head + b"\r\n" + block + b"\r\n\r\n"


def _clean(value: str) -> str:
    """A header value holds no line ends; they are percent-encoded, and so is the percent sign before them."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame: the dictionary as a Zstandard frame."""
    body = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary) if dictionary else b""
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A raw-content dictionary: the samples' openings, cut to ``size`` (deterministic)."""
    out, share = bytearray(), max(256, size // max(1, len(samples)))
    for s in samples:
        out += s[:share]
    return bytes(out[-size:]) if len(out) >= 8 else b""


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record; raises :class:`WarcError` on any fault."""
    if len(data) < 8:
        raise WarcError("shorter than a frame header")
    magic, size = struct.unpack_from("<II", data, 0)
    if magic != SKIPPABLE_MAGIC:
        raise WarcError(f"no leading dictionary frame (magic {magic:#x})")
    if 8 + size > len(data):
        raise WarcError("dictionary frame is cut off")
    body = data[8 : 8 + size]
    if body[:4] == struct.pack("<I", FRAME_MAGIC):
        body = zstandard.ZstdDecompressor().decompress(body)
    # a trained dictionary says so by its magic number; anything else is raw content
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body)) if body else zstandard.ZstdDecompressor()
    at, view = 8 + size, memoryview(data)
    while at < len(data):
        one, parts, end = decoder.decompressobj(), [], at
        try:
            while not one.eof and end < len(data):
                parts.append(one.decompress(view[end : end + FEED]))
                end = min(end + FEED, len(data))
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {at}: {e}") from None
        if not one.eof:
            raise WarcError(f"frame at byte {at} is cut off")
        at = end - len(one.unused_data)
        yield parse_record(b"".join(parts))


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one decoded record, validated."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in VERSIONS:
        raise WarcError("bad version line or no end of header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        key = name.decode().strip()
        if key in fields and key != "WARC-Concurrent-To":  # the one that may stand there again
            raise WarcError(f"repeated header {key}")
        fields[key] = value.decode().strip()
    for need in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if need not in fields:
            raise WarcError(f"no {need}")
    if not fields["Content-Length"].isdigit():
        raise WarcError("Content-Length isn't a number")
    n = int(fields["Content-Length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, {n} declared")
    block = rest[:n]
    # the payload of an HTTP message is a part of the block only
    whole = fields["WARC-Type"] == "response" and not fields.get("Content-Type", "").startswith("application/http")
    for name in ("WARC-Block-Digest", *(["WARC-Payload-Digest"] if whole else [])):
        want = fields.get(name, "")
        if want.startswith("sha1:") and base64.b32encode(hashlib.sha1(block).digest()).decode() != want.removeprefix("sha1:").upper():
            raise WarcError(f"{name} differs")
    return fields, block


def record_row(fields: dict[str, str], block: bytes, with_payload: bool) -> tuple:
    """A record as a row of ``RECORD``."""
    def number(name: str) -> int | None:
        text = fields.get(name, "")
        return int(text) if text.lstrip("-").isdigit() else None

    kind, digest = fields["WARC-Type"], fields.get("WARC-Payload-Digest", "")
    hexed = base64.b32decode(digest.removeprefix("sha1:").upper()).hex() if digest.startswith("sha1:") else hashlib.sha1(block).hexdigest()
    revisit = kind == "revisit"
    length = number("WARC-Payload-Length") if revisit else len(block)
    return number("WARC-Page-ID"), fields.get("WARC-Target-URI"), length, hexed, kind, number("WARC-Refers-To") if revisit else None, block if with_payload and not revisit else None


def with_record_types(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (bytes), digest, kind, refers_to.

    ``kind`` is response for the largest page id of equal long payloads and for short ones."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    base = base.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    # Only digests that repeat have a row here.  The table is written first, so the planner
    # knows its size: broadcast while small, otherwise a shuffled join that splits hot digests.
    keep = stage_table(base.where(F.col("n") >= min_bytes).groupBy(F.col("digest").alias("k"), F.col("n").alias("kn"))
            .agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"), "repeated-payloads")
    joined = base.join(keep, (F.col("digest") == F.col("k")) & (F.col("n") == F.col("kn")), "left")
    revisit = F.col("owner").isNotNull() & (F.col("owner") != F.col("page_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"),
                         F.when(revisit, F.col("owner")).alias("refers_to"))


def _archives(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary, zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
        head, frames, held = dictionary_frame(dictionary), [], 0
        emit = lambda: pa.RecordBatch.from_arrays([pa.array([head + b"".join(frames)], pa.binary())], names=["archive"])
        for b in batches:
            for page_id, url, payload, digest, kind, refers in zip(*(c.to_pylist() for c in b.columns)):
                frames.append(coder.compress(record_bytes(kind, url, payload, digest, page_id, refers)))
                held += len(payload)
                if held >= ARCHIVE_BYTES:
                    yield emit()
                    frames, held = [], 0
        if frames:
            yield emit()

    return run


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Archives as a table of binary rows (column ``archive``) under ``path``, any store."""
    # The first ids only, then their openings: what reaches the driver doesn't grow with the pages.
    first = [r["page_id"] for r in pages.where(F.length("html") > 0).select("page_id").orderBy("page_id").limit(DICT_SAMPLES).collect()]
    sample = [r["opening"].encode() for r in pages.where(F.col("page_id").isin(first)).select("page_id", F.substring("html", 1, 1024).alias("opening"))
              .where(F.length("opening") > 0).orderBy("page_id", "opening").limit(DICT_SAMPLES).collect()] if first else []
    typed = with_record_types(pages, min_bytes).select("page_id", "url", "payload", "digest", "kind", "refers_to")
    map_batches(typed, _archives(train_dictionary(sample)), "archive binary").write.parquet(path, compression="none")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of a table written by :func:`write_archives`."""
    return decode_archives(spark.read.parquet(path).select("archive"), with_payload)


def read_archive_files(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of archive files (``*.warc.zst``) in any store Spark reads."""
    return decode_archives(spark.read.format("binaryFile").load(path).select("content"), with_payload)


def decode_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record.  A revisit has its header's length and digest and a null payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for value in b.column(0):
                rows = [record_row(f, block, with_payload) for f, block in parse_archive(value.as_py())]
                if not rows:
                    continue
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                 names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return map_batches(archives, run, RECORD)


def warc_round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
