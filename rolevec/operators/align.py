"""Motion union per level and the aligned (dense) view.

Cells stay sparse through the method: ``(id, level, motion, value)`` with one
row per motion a role holds.  The dense view -- every role x every motion of
its level's union -- is only built when asked for (:func:`align_union`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def motion_union(cells: DataFrame) -> DataFrame:
    """Distinct ``(level, motion)`` of a level across all roles (pad key included)."""
    return cells.select("level", "motion").distinct()


def union_size(union: DataFrame) -> DataFrame:
    """``(level, n)`` per level plus a total row with ``level`` NULL."""
    return union.rollup("level").agg(F.count(F.lit(1)).alias("n"))


def align_union(cells: DataFrame, union: DataFrame, id_col: str = "id") -> DataFrame:
    """Dense cells ``(id, level, motion, value)``: every motion of the level's
    union for every (id, level), 0.0 where the id lacks it.

    Cells are gathered per (id, level) into a map (bounded by the top-k), the
    union per level into an array (one row per level, small, broadcast by AQE);
    each (id, level) row then expands locally -- no join on the dense side.
    """
    per = (cells.groupBy(id_col, "level")
           .agg(F.map_from_entries(F.collect_list(F.struct("motion", "value"))).alias("_m")))
    unions = union.groupBy("level").agg(F.sort_array(F.collect_list("motion")).alias("_u"))
    return (per.join(unions, on="level", how="inner")
            .select(id_col, "level", F.explode("_u").alias("motion"), "_m")
            .select(id_col, "level", "motion",
                    F.coalesce(F.try_element_at(F.col("_m"), F.col("motion")), F.lit(0.0)).alias("value")))
