"""Bitmaps of integers, sized by their number, that tasks use to leave out what can't match.

A set bit only says "maybe": whatever passes is matched exactly afterwards.  The bitmap is
built by Spark's bitmap aggregation, so the driver receives the bits and nothing else.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_VALUE = 16  # bits for a value, while the bound allows
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28  # at most 32 MB; beyond that the bitmap leaves out less
BUCKET = 1 << 15  # bits that one aggregate holds


def bitmap(values: DataFrame, column: str) -> np.ndarray:
    """Bytes with bit v modulo their number of bits set for every value (a power of two).

    ``values`` is read twice, so it should be a written table."""
    n = values.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (PER_VALUE * n).bit_length()))
    at = F.pmod(F.col(column).cast("long"), F.lit(bits))
    spots = values.select(F.floor(at / BUCKET).cast("int").alias("bucket"), (at % BUCKET).alias("spot")).where("spot is not null")
    out = np.zeros((bits // BUCKET, BUCKET // 8), np.uint8)
    for r in spots.groupBy("bucket").agg(F.bitmap_construct_agg("spot").alias("bits")).collect():
        out[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def marked(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which 64-bit integers may be among the bitmap's."""
    at = value.view(np.int64) & (8 * len(bits) - 1)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def maybe(bits: np.ndarray, column: Column) -> Column:
    """The same as a column (false for null): only the integers go through Python, not the rows."""

    @F.pandas_udf("boolean")
    def test(v: pd.Series) -> pd.Series:
        return pd.Series(marked(bits, v.to_numpy().astype(np.int64)))

    # nulls would turn the ids of a batch into doubles
    return column.isNotNull() & test(F.coalesce(column.cast("long"), F.lit(0).cast("long")))
