"""Keep the first informative columns of every level and assemble vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolevec import defaults

ORDERS = ("name", "cost_asc", "cost_desc")


def kept_columns(informative: DataFrame, n: int = defaults.KEPT_PER_LEVEL, order: str = "name") -> DataFrame:
    """``(level, rank, motion, [cost])``: the first ``n`` informative columns of
    each level.  ``order``: ``name`` (motion ascending; needs no cost), ``cost_asc`` or
    ``cost_desc`` (cost at 6 decimals, ties by motion)."""
    if n <= 0:
        raise ValueError(f"number of kept dimensions must be positive, got {n}")
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}, got {order!r}")
    # costs compare at 6 decimals: equal optima computed along different paths
    # may differ in the last bits, and must still tie (then by motion)
    keys = [F.col("motion").asc()]
    if order != "name":
        cost = F.round("cost", 6)
        keys.insert(0, cost.asc() if order == "cost_asc" else cost.desc())
    w = Window.partitionBy("level").orderBy(*keys)
    return (informative.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= F.lit(n))
            .select("level", F.col("rank").cast("int").alias("rank"), "motion", *(["cost"] if "cost" in informative.columns else [])))


def reduced_cells(cells: DataFrame, kept: DataFrame, lo: int, n: int = defaults.KEPT_PER_LEVEL,
                  id_col: str = "id") -> DataFrame:
    """``(id, pos, value)`` for the kept columns, ``pos = (level - lo) * n + rank - 1``.

    ``kept`` has at most ``n`` rows per level (levels x n overall, fixed by the
    parameters), so it is broadcast; the cells never move."""
    k = kept.select("level", "motion", "rank")
    return (cells.join(F.broadcast(k), on=["level", "motion"], how="inner")
            .select(id_col, ((F.col("level") - F.lit(lo)) * F.lit(n) + F.col("rank") - 1).cast("int").alias("pos"),
                    "value"))


def assemble_vectors(reduced: DataFrame, roles: DataFrame, width: int, id_col: str = "id") -> DataFrame:
    """``(id, label, features array<double>)`` of length ``width``; positions
    without a kept cell are 0.0.  Every role of ``roles (id, label)`` gets a
    row, also one without any kept cell.  One aggregation per role, whose input
    is bounded by ``width``."""
    # both sides group by id, then meet by id: tables bucketed by id pass without an exchange
    marks = roles.groupBy(id_col).agg(F.max(F.col("label").cast("int")).alias("label")).where(F.col("label").isNotNull())
    cells = reduced.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("pos", "value"))).alias("_m"))
    per = marks.join(cells, id_col, "left")
    feats = F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                        lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0)))
    return per.select(id_col, "label", (feats if width > 0 else F.array().cast("array<double>")).alias("features"))


def to_vector(arr: Column | str) -> Column:
    """Array of doubles -> ML dense vector."""
    return array_to_vector(F.col(arr) if isinstance(arr, str) else arr)
