"""Per (level, motion) ranges and min-max scaling of the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolevec import defaults


def motion_ranges(counts: DataFrame, n_roles: Column) -> DataFrame:
    """``(level, motion, mx, mn)``.

    ``mn`` is the real minimum only when every role holds the motion at that
    level (a role without it has an implicit 0), else 0.  ``n_roles`` is a
    scalar column, e.g. :func:`role_count_value`.
    """
    return (counts.groupBy("level", "motion")
            .agg(F.max("cnt").alias("mx"), F.min("cnt").alias("_min"), F.count(F.lit(1)).alias("_holders"))
            .select("level", "motion", F.col("mx").cast("long").alias("mx"),
                    F.when(F.col("_holders") == n_roles, F.col("_min")).otherwise(F.lit(0))
                    .cast("long").alias("mn")))


def scale_value(cnt: Column, mx: Column, mn: Column, scale: float = defaults.SCALE) -> Column:
    """``scale * (cnt - mn) / (mx - mn)``, 0 when ``mx = mn``."""
    ratio = (cnt - mn).cast("double") / (mx - mn).cast("double")
    return F.when(mx == mn, F.lit(0.0)).otherwise(F.lit(float(scale)) * ratio)


def scale_counts(counts: DataFrame, ranges: DataFrame, scale: float = defaults.SCALE) -> DataFrame:
    """``(role, level, motion, value)``.

    ``ranges`` has one row per (level, motion): far smaller than the counts,
    so AQE turns this join into a broadcast when its measured size allows and
    keeps a shuffled join otherwise."""
    j = counts.join(ranges, on=["level", "motion"], how="inner")
    return j.select("role", "level", "motion",
                    scale_value(F.col("cnt"), F.col("mx"), F.col("mn"), scale).alias("value"))
