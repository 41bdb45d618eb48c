"""Sequences -> top-k vectors (the first stage of the method).

rows (role, level, motion) -> trim -> counts -> coverage -> ranges -> scaling
-> top-k with padding -> per-role vectors.  Nothing is collected; the role
count is a scalar subquery; tables with several consumers are staged once in
the shared checkpoint folder (see ``vectorize(materialize=...)``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolevec import defaults
from rolevec.session import stage_bucketed, stage_table
from rolevec.operators.counts import covered_counts, motion_counts, trim_levels
from rolevec.operators.scaling import motion_ranges, scale_value
from rolevec.operators.topk import level_grid, rank_topk, sparse_cells, topk_motions, topk_padded, unaligned_vectors


@dataclass
class Vectorized:
    counts: DataFrame      # (role, level, motion, cnt) of covered roles
    n_roles: Column        # scalar, or the number itself
    ranges: DataFrame      # (level, motion, mx, mn)
    scaled: DataFrame      # (role, level, motion, value)
    marked: DataFrame      # (role, level, motion, value, label), NULL motion = level without motions
    presence: DataFrame    # (role, level)
    ranked: DataFrame      # (role, level, label, slot, motion, value, is_pad, pad_idx)
    roles: DataFrame       # (role, label)
    lo: int
    hi: int
    k: int

    @property
    def topk(self) -> DataFrame:
        return topk_motions(self.ranked)

    @property
    def padded(self) -> DataFrame:
        return topk_padded(self.ranked)

    @property
    def unaligned(self) -> DataFrame:
        return unaligned_vectors(self.ranked.select("role", "level", "slot", "motion", "value", "label"))

    def cells(self) -> DataFrame:
        """Sparse unique cells for the reduction stage: ``(id, label, level, motion, value)``."""
        return (sparse_cells(self.ranked, carry=("label",))
                .select(F.col("role").alias("id"), "label", "level", "motion", "value"))


def vectorize(rows: DataFrame, positives: DataFrame, lo: int = defaults.LEVEL_SPAN[0],
              hi: int = defaults.LEVEL_SPAN[1], k: int = defaults.TOP_K, keep_below: bool = False,
              scale: float = defaults.SCALE, materialize: bool = True) -> Vectorized:
    """``rows``: ``(role, level, motion)``, one per event (motion NULL marks an
    empty level record).  ``positives``: ``DF[id]`` of known cases.

    With ``materialize`` (the default) the tables with several consumers --
    the labelled counts of covered roles, bucketed by role, and their ranges -- are written
    once to the shared checkpoint folder, so the input is scanned once; without it
    everything stays one lazy plan.  The ranked slots stay lazy on these tables: ranking,
    padding and vectors read the buckets without a further exchange."""
    if k <= 0:
        raise ValueError(f"top-k must be positive, got {k}")
    if lo > hi:
        raise ValueError(f"empty level span {lo}..{hi}")
    # a level record without motions keeps its row with a NULL motion
    covered = covered_counts(motion_counts(trim_levels(rows, lo, hi, keep_below)), positives, lo, hi)
    if materialize:
        # the write counts the roles: the ranges need their number
        covered, seen = stage_bucketed(covered, "covered", "role", ("role", "level"), (F.count_if("first").alias("n"),))
        n_roles = F.lit(int(seen["n"]))
    else:
        n_roles = covered.agg(F.count_if("first")).scalar()
    roles = covered.where("first").select("role", "label")
    covered = covered.drop("first")
    counts = covered.where(F.col("motion").isNotNull()).drop("label")
    ranges = motion_ranges(counts, n_roles)
    if materialize:
        # a small table of known size: the counts meet it without an exchange
        ranges = stage_table(ranges, "ranges")
    # left join: marker rows of empty levels survive with a NULL value
    marked = covered.join(ranges, on=["level", "motion"], how="left") \
        .select("role", "level", "motion", "label",
                F.when(F.col("motion").isNotNull(), scale_value(F.col("cnt"), F.col("mx"), F.col("mn"), scale))
                .alias("value"))
    scaled = marked.where(F.col("motion").isNotNull()).drop("label")
    if keep_below:
        first = F.least(covered.agg(F.min("level")).scalar(), F.lit(lo))
        presence = roles.select("role", "label", F.explode(F.sequence(first, F.lit(hi))).alias("level"))
        ranked = rank_topk(marked, k, presence=presence, carry=("label",))
    else:
        presence = level_grid(roles, lo, hi)
        ranked = rank_topk(marked, k, carry=("label",))
    return Vectorized(counts, n_roles, ranges, scaled, marked, presence, ranked, roles, lo, hi, k)
