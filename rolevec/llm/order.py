"""Positions and running values within groups, without a task per group.

Rows are dealt by range over (group, order) and sorted within the partitions, so a group
of any size is spread over as many of them as it fills.  One pass numbers the rows of each
partition; a table of one row per partition and group gives what earlier partitions hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from rolevec.llm.ship import map_batches
from rolevec.session import stage_table


def _changes(column: pa.Array) -> np.ndarray:
    """Which rows differ from the row before them (nulls are equal)."""
    if len(column) < 2:
        return np.zeros(0, bool)
    a, b = column[1:], column[:-1]
    apart = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return apart | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))


def starts_of(columns: list[pa.Array]) -> np.ndarray:
    """First rows of the runs of equal values."""
    n = len(columns[0])
    if n == 0:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= _changes(c)
    return np.flatnonzero(new)


def _numbered(df: DataFrame, group: list[str], xors: list[str], sums: list[str]) -> DataFrame:
    """Adds __part, __pos and, per column, the value over earlier rows of its group in the partition."""
    values = [*xors, *sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: list[pa.Array] | None = None
        held = np.zeros(1 + len(values), np.int64)  # rows and values of the open group so far
        for b in batches:
            n = b.num_rows
            if n == 0:
                continue
            keys = [b.column(c) for c in group]
            start = starts_of(keys)
            goes_on = last is not None and all(len(starts_of([pa.concat_arrays([x, k.slice(0, 1)])])) == 1 for x, k in zip(last, keys))
            if not goes_on:
                held[:] = 0
            first = np.repeat(start, np.diff(np.append(start, n)))
            carried = np.where(first == 0, 1, 0)
            out = [np.arange(n) - first + carried * held[0]]
            for j, c in enumerate(values):
                v = pc.fill_null(b.column(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                if j < len(xors):
                    run_up = np.append(0, np.bitwise_xor.accumulate(v))
                    out.append(run_up[:-1] ^ run_up[first] ^ (carried * held[1 + j]))
                else:
                    run_up = np.append(0, np.cumsum(v))
                    out.append(run_up[:-1] - run_up[first] + carried * held[1 + j])
            # what the batch's last group holds, its last row included
            tail = [out[0][-1] + 1]
            for j, c in enumerate(values):
                v = b.column(c)[n - 1].as_py() or 0
                tail.append((int(out[1 + j][-1]) ^ v) if j < len(xors) else int(out[1 + j][-1]) + v)
            held[:] = tail
            last = [k.slice(n - 1, 1) for k in keys]
            cols = [*b.columns, pa.array(np.full(n, part, np.int32)), *(pa.array(x, pa.int64()) for x in out)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "__part", "__pos", *(f"__{c}" for c in values)])

    schema = StructType([*df.schema.fields, StructField("__part", IntegerType()), StructField("__pos", LongType()), *(StructField(f"__{c}", LongType()) for c in values)])
    return map_batches(df, run, schema)


def in_order(df: DataFrame, group: list[str], order: list[str], xors: list[str] = [], sums: list[str] = [], groups: bool = False) -> DataFrame:
    """``df`` plus ``pos`` (from 0, within the group) and, for each column c of ``xors`` and
    ``sums`` (64-bit integers), ``before_c``: its XOR or sum over the group's earlier rows.
    With ``groups`` also ``total`` (rows of the group) and ``number`` (of the group, from 0).

    Rows that are equal in group and order are taken in any order.  ``df`` is read twice (once
    for the ranges), so it should be a written table."""
    values = [*xors, *sums]
    keys = [*group, *order]
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stage_table(_numbered(sorted_rows, group, xors, sums), "ordered")
    folds = [F.count(F.lit(1)).alias("__n"), *(F.bit_xor(c).alias(f"__t_{c}") for c in xors), *(F.sum(c).alias(f"__t_{c}") for c in sums)]
    parts = stage_table(rows.groupBy("__part", *group).agg(*folds), "ordered-parts")
    own = Window.partitionBy(*group)
    before = own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    known = parts.select(
        "__part", *group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__rows"), F.min("__part").over(own).alias("__first"), F.sum("__n").over(own).alias("total"),
        *(F.coalesce(F.bit_xor(f"__t_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in xors),
        *(F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__b_{c}") for c in sums))
    if groups:
        # groups that begin in a partition, numbered after those of earlier partitions (one row a partition)
        firsts = known.where("__part = __first")
        counts = firsts.groupBy("__part").agg(F.count(F.lit(1)).alias("__k"))
        earlier = counts.select("__part", F.coalesce(F.sum("__k").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__earlier"))
        inside = firsts.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*group)) - 1)
        named = inside.join(earlier, "__part").select(*(F.col(g).alias(f"__g_{g}") for g in group), (F.col("__earlier") + F.col("__in")).cast("long").alias("number"))
        same = [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group]
        known = known.join(named, _all(same)).drop(*(f"__g_{g}" for g in group))
    else:
        known = known.where("__part > __first").drop("total")  # at most one group a partition goes on from earlier ones
    known = stage_table(known.drop("__first"), "ordered-offsets")
    known = known.select(F.col("__part").alias("__p"), *(F.col(g).alias(f"__k_{g}") for g in group), *(c for c in known.columns if c not in ("__part", *group)))
    met = rows.join(known, _all([F.col("__part") == F.col("__p"), *(F.col(g).eqNullSafe(F.col(f"__k_{g}")) for g in group)]), "left")
    zero = F.lit(0).cast("long")
    return met.select(*df.columns, (F.col("__pos") + F.coalesce("__rows", zero)).alias("pos"),
                      *(F.col(f"__{c}").bitwiseXOR(F.coalesce(f"__b_{c}", zero)).alias(f"before_{c}") for c in xors),
                      *((F.col(f"__{c}") + F.coalesce(f"__b_{c}", zero)).alias(f"before_{c}") for c in sums),
                      *(["total", "number"] if groups else []))


def _all(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
