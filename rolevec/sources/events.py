"""Adapter from a raw ``events`` table to level records.

The original method starts from level records ``(role, mark, seqs)`` produced
by steps that are not part of it.  This adapter derives them from an event log
``(event_id, ts, user_id, event_type, props)``:

* role   = ``user_id``
* level  = ``floor(days since epoch / days_per_level) + first_level``
* motion = ``event_type`` or ``event_type || '_' || (props.k mod 2)``
* token  = ``event_id@motion@p0,,p1,,p2,,p3`` with parameters taken from
  ``props.k`` (``k``, ``k mod 10``, ``k div 10``, ``event_type``)

All of it is column expressions over a pruned parquet scan, but for the pass that cuts
sorted tokens into records.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The pass that cuts records runs in Python workers: its code ships with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EPOCH = "2024-01-01"
MAX_TOKENS = 10_000  # of a level record, about
LEHMER_FACTOR, LEHMER_MODULUS = 182605794, 2147483647  # fixed values: two steps of the generator (48271 squared), its modulus


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")


def prop_k(props: str = "props") -> Column:
    return F.get_json_object(F.col(props), "$.k").cast("long")


def event_level(ts: str = "ts", days_per_level: int = 6, first_level: int = 2,
                epoch: str = EPOCH) -> Column:
    days = F.datediff(F.to_date(F.col(ts)), F.lit(epoch).cast("date"))
    return (F.floor(days / F.lit(days_per_level)) + F.lit(first_level)).cast("int")


def event_motion(event_type: str = "event_type", props: str = "props", parity: bool = True) -> Column:
    if not parity:
        return F.col(event_type)
    return F.concat(F.col(event_type), F.lit("_"), F.pmod(prop_k(props), F.lit(2)).cast("string"))


def event_token(motion: Column, event_id: str = "event_id", props: str = "props",
                event_type: str = "event_type") -> Column:
    k = prop_k(props)
    params = F.concat_ws(",,", k.cast("string"), F.pmod(k, F.lit(10)).cast("string"),
                         F.call_function("div", k, F.lit(10)).cast("string"), F.col(event_type))
    return F.concat_ws("@", F.col(event_id).cast("string"), motion, params)


def level_span_filter(lo: int | None, hi: int, ts: str = "ts", days_per_level: int = 6, first_level: int = 2,
                      epoch: str = EPOCH) -> Column:
    """The raw-time form of ``lo <= level <= hi`` (no lower bound if ``lo`` is None): a
    ``ts`` range that the parquet reader can use for row-group (and partition) pruning."""
    import datetime as dt

    base = dt.date.fromisoformat(epoch)
    end = base + dt.timedelta(days=(hi - first_level + 1) * days_per_level)
    before = F.col(ts) < F.lit(f"{end} 00:00:00").cast("timestamp_ntz")
    if lo is None:
        return before
    start = base + dt.timedelta(days=(lo - first_level) * days_per_level)
    return (F.col(ts) >= F.lit(f"{start} 00:00:00").cast("timestamp_ntz")) & before


def event_rows(events: DataFrame, days_per_level: int = 6, first_level: int = 2,
               parity: bool = True, span: tuple[int | None, int] | None = None) -> DataFrame:
    """Long rows ``(role bigint, level int, motion string)``, one per event.

    ``span=(lo, hi)`` keeps only events of those levels, as a predicate on the
    raw ``ts`` column (pushed into the scan)."""
    if span is not None:
        events = events.where(level_span_filter(span[0], span[1], "ts", days_per_level, first_level))
    return events.select(
        F.col("user_id").cast("long").alias("role"),
        event_level("ts", days_per_level, first_level).alias("level"),
        event_motion("event_type", "props", parity).alias("motion"),
    )


def token_rows(events: DataFrame, days_per_level: int = 6, first_level: int = 2,
               parity: bool = True) -> DataFrame:
    """``(role, level, ts, event_id, token)``, one per event."""
    motion = event_motion("event_type", "props", parity)
    return events.select(
        F.col("user_id").cast("long").alias("role"),
        event_level("ts", days_per_level, first_level).alias("level"),
        F.col("ts"),
        F.col("event_id"),
        event_token(motion).alias("token"),
    )


def record_part(n: Column, max_tokens: int, event_id: str = "event_id") -> Column:
    """Which of the records of a (role, level, day) with ``n`` tokens one belongs to (from 0): a
    Lehmer mix of its id over as many parts as ``max_tokens`` asks for."""
    parts = F.ceil(n / F.lit(max_tokens)).cast("long")
    mixed = F.pmod(F.pmod(F.col(event_id), F.lit(LEHMER_MODULUS)) * F.lit(LEHMER_FACTOR), F.lit(LEHMER_MODULUS))
    return F.call_function("div", mixed * parts, F.lit(LEHMER_MODULUS))  # by size: remainders of few ids are uneven


def level_records(tokens: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Level records ``(role string, mark string, seqs array<string>)``.

    One record per (role, level, day of the events), or several of about ``max_tokens``
    tokens where there are more: the record format allows repeated levels.  Tokens are in
    the order of time within a record.

    The days are counted first, a sum that combines before its exchange.  Rows are then dealt
    by (role, level, day, part) and sorted within the partitions; one pass cuts the sorted rows
    into records.  So neither a list nor a task grows with a user's events: a user with a
    third of them fills as many parts as they need."""
    key = ["role", "level", "_day"]
    rows = tokens.select("role", "level", "ts", "event_id", "token", F.to_date("ts").alias("_day"))
    # only what must be parted: at most one row per max_tokens tokens
    heavy = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_tokens)
    parted = rows.join(heavy, key, "left").withColumn("_part", F.when(F.col("_n").isNull(), F.lit(0)).otherwise(record_part(F.col("_n"), max_tokens)).cast("long"))
    dealt = parted.repartition(*key, "_part").sortWithinPartitions(*key, "_part", "ts", "event_id")
    return dealt.select("role", "level", "_day", "_part", "token").mapInArrow(_cut_records, "role string, mark string, seqs array<string>")


def _cut_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key columns, token) as one row per run of equal keys.

    The last run of a batch may go on in the next one and is held back."""
    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        starts = _run_starts(t)
        last = int(starts[-1]) if len(starts) else 0
        held = t.slice(last)
        if last:
            yield _records(t.slice(0, last), starts[:-1])
    if held is not None and held.num_rows:
        yield _records(held, np.zeros(1, np.int64))


def _run_starts(t: pa.Table) -> np.ndarray:
    """First rows of the runs of equal key columns (all but the last; nulls are equal)."""
    if t.num_rows == 0:
        return np.zeros(0, np.int64)
    new = np.ones(t.num_rows, bool)
    new[1:] = False
    for name in t.column_names[:-1]:
        c = t.column(name).combine_chunks()
        c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        apart = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        new[1:] |= apart | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.flatnonzero(new)


def _records(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.append(starts, t.num_rows), pa.int32())
    token = t.column("token").cast(pa.string()).combine_chunks()
    token = token.chunk(0) if isinstance(token, pa.ChunkedArray) else token
    at = pa.array(starts)
    text = lambda name: pc.cast(t.column(name).take(at), pa.string()).combine_chunks()
    one = lambda c: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return pa.RecordBatch.from_arrays([one(text("role")), one(text("level")), pa.ListArray.from_arrays(offsets, token)], names=["role", "mark", "seqs"])


def positive_ids(events: DataFrame, every: int = 10) -> DataFrame:
    """Known-case ids of the test tables: users whose id is a multiple of ``every``."""
    return (events.select(F.col("user_id").cast("long").alias("id"))
            .where(F.pmod(F.col("id"), F.lit(every)) == 0).distinct())
