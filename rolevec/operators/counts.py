"""Level records -> per (role, level, motion) counts; coverage and trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolevec import defaults
from rolevec.functions.tokens import parse_level, token_expand, token_motion


WORD_LEVELS = 62  # levels whose presence one 64-bit word holds


def explode_sequences(records: DataFrame, expand: bool = False, param_index=None) -> DataFrame:
    """Level records ``(role, mark, seqs)`` -> ``(role, level int, motion)``; the role as given.

    One row per token; a record with an empty ``seqs`` keeps one row with a
    NULL motion so that its level still counts as present.
    """
    motion = (lambda t: token_expand(t, param_index, strict=True)) if expand else \
        (lambda t: token_motion(t, strict=True))
    return (records
            .select("role",
                    parse_level("mark").alias("level"),
                    F.explode_outer("seqs").alias("_tok"))
            .select("role", "level", F.when(F.col("_tok").isNotNull(), motion(F.col("_tok"))).alias("motion")))


def trim_levels(rows: DataFrame, lo: int = defaults.LEVEL_SPAN[0], hi: int = defaults.LEVEL_SPAN[1],
                keep_below: bool = False) -> DataFrame:
    """Keep levels ``<= hi`` and, unless ``keep_below``, ``>= lo``.

    A plain filter: on a parquet-backed plan it runs before any exchange."""
    cond = F.col("level") <= F.lit(hi)
    if not keep_below:
        cond = cond & (F.col("level") >= F.lit(lo))
    return rows.where(cond)


def motion_counts(rows: DataFrame) -> DataFrame:
    """``(role, level, motion, cnt)``.  Repeated (role, level) records merge.

    Partial (map-side) aggregation first, so a heavy user is pre-summed before
    the exchange.  Rows of empty records give ``(role, level, NULL, 0)``.
    """
    return rows.groupBy("role", "level", "motion").agg(F.count("motion").alias("cnt"))


def _level_words(lo: int, hi: int) -> dict[str, Column]:
    """Aggregates: the levels of ``lo..hi`` as bits, ``WORD_LEVELS`` to a word."""
    in_span = (F.col("level") >= lo) & (F.col("level") <= hi)
    place = F.col("level") - F.lit(lo)

    def bits(w):
        inside = in_span & (F.call_function("div", place, F.lit(WORD_LEVELS)) == w)
        return F.bit_or(F.when(inside, F.call_function("shiftleft", F.lit(1).cast("long"), (place - w * WORD_LEVELS).cast("int"))).otherwise(F.lit(0).cast("long")))

    return {f"_w{w}": bits(w) for w in range(-(-(hi - lo + 1) // WORD_LEVELS))}


def _whole(words: dict[str, Column], lo: int, hi: int) -> Column:
    return sum((F.bit_count(F.col(w)) for w in words), F.lit(0)) == F.lit(hi - lo + 1)


def covered_roles(counts: DataFrame, lo: int = defaults.LEVEL_SPAN[0],
                  hi: int = defaults.LEVEL_SPAN[1]) -> DataFrame:
    """Roles present at every level of ``lo..hi``: ``DF[role]``.

    A role's levels are bits, or-ed together in one aggregation: one exchange of a few
    words per role and task, no distinct (role, level) rows."""
    words = _level_words(lo, hi)
    in_span = (F.col("level") >= lo) & (F.col("level") <= hi)
    return (counts.where(in_span).groupBy("role").agg(*[c.alias(w) for w, c in words.items()])
            .where(_whole(words, lo, hi)).select("role"))


def covered_counts(counts: DataFrame, positives: DataFrame, lo: int = defaults.LEVEL_SPAN[0],
                   hi: int = defaults.LEVEL_SPAN[1]) -> DataFrame:
    """``(role, level, motion, cnt, label, first)``: the counts of the covered roles with the
    known-case flag; ``first`` marks one row per role.

    Known cases enter as marker rows, so coverage, flag and mark are windows over one dealing
    by role: no role table, no join.  A role's rows are bounded by levels x vocabulary."""
    types = {f.name: f.dataType for f in counts.schema}
    known = positives.select(F.col(positives.columns[0]).cast(types["role"]).alias("role"))
    marks = known.select("role", *[F.lit(None).cast(types[c]).alias(c) for c in ("level", "motion", "cnt")], F.lit(1).alias("_known"))
    rows = counts.select("role", "level", "motion", "cnt", F.lit(0).alias("_known")).unionByName(marks).where(F.col("role").isNotNull())
    order = Window.partitionBy("role").orderBy(F.col("level").asc_nulls_last(), "motion")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words = _level_words(lo, hi)
    seen = rows.select("*", *[c.over(whole).alias(w) for w, c in words.items()], F.max("_known").over(whole).alias("label"),
                       (F.row_number().over(order) == 1).alias("first"))
    return seen.where(F.col("level").isNotNull() & _whole(words, lo, hi)).select("role", "level", "motion", "cnt", "label", "first")


def coverage_filter(counts: DataFrame, lo: int = defaults.LEVEL_SPAN[0],
                    hi: int = defaults.LEVEL_SPAN[1], roles: DataFrame | None = None) -> DataFrame:
    """Rows of roles that have every level of the span.

    An inner join to the (distinct) covered roles: unlike a semi join it is not
    pushed below the count aggregation, so it filters the pre-aggregated counts
    rather than the raw events."""
    roles = covered_roles(counts, lo, hi) if roles is None else roles
    return counts.join(roles, on="role", how="inner")


def role_count(rows: DataFrame) -> DataFrame:
    """One row ``n_roles``."""
    return rows.agg(F.count_distinct("role").alias("n_roles"))


def role_count_value(rows: DataFrame) -> Column:
    """``n_roles`` as a scalar subquery column (evaluated once, no join)."""
    return role_count(rows).scalar()
