"""Composite label (``id * 10 + label``) and label flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode_label(id_col: Column | str = "id", label_col: Column | str = "label") -> Column:
    """``id ‖ label`` as one number; the label is a single digit."""
    return _col(id_col).cast("long") * F.lit(10) + _col(label_col).cast("long")


def decode_label(mix: Column | str = "mix") -> tuple[Column, Column]:
    """``(id, label)`` from a composite label (text or integer, also ``x.0`` forms).

    Exact for every bigint: the value never passes through a double.  A fraction, or a
    label digit other than 0 and 1, raises."""
    given = _col(mix).cast("decimal(38,6)")
    m = given.cast("long")
    label = F.pmod(m, F.lit(10)).cast("int")
    bad = (given != m) | ~label.isin(0, 1)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("not a composite label: "), _col(mix).cast("string"))).cast("int")).otherwise(label)
    return F.call_function("div", m, F.lit(10)).cast("long"), checked


def flag_labels(df: DataFrame, positives: DataFrame, id_col: str = "role",
                positive_col: str | None = None, out: str = "label") -> DataFrame:
    """Add ``out`` = 1 for rows whose id is in ``positives`` else 0.

    ``positives`` is a one-column (or ``positive_col``) DataFrame of ids; it is
    de-duplicated and left-joined, so it never travels through the driver.
    """
    pcol = positive_col or positives.columns[0]
    ids = (positives.select(F.col(pcol).cast(df.schema[id_col].dataType).alias(id_col))
           .where(F.col(id_col).isNotNull()).distinct()
           .withColumn("_is_pos", F.lit(1)))
    return (df.join(ids, on=id_col, how="left")
              .withColumn(out, F.coalesce(F.col("_is_pos"), F.lit(0)).cast("int"))
              .drop("_is_pos"))
