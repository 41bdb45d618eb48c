"""Top-k cells -> aligned columns -> column scores -> kept columns -> reduced
vectors (the second stage of the method)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolevec import defaults
from rolevec.operators.align import align_union, motion_union, union_size
from rolevec.operators.colcost import column_cost, column_distinct, column_histogram, informative_columns
from rolevec.operators.reduce import assemble_vectors, kept_columns, reduced_cells
from rolevec.session import stage_bucketed, stage_table


@dataclass
class Reduction:
    cells: DataFrame        # (id, label, level, motion, value)
    n_roles: Column
    roles: DataFrame        # (id, label)
    union: DataFrame        # (level, motion)
    histogram: DataFrame    # (level, motion, value, w)
    distinct: DataFrame     # (level, motion, n_distinct)
    costs: DataFrame        # (level, motion, n_distinct, cost), computed when read
    kept: DataFrame         # (level, rank, motion, cost)
    reduced: DataFrame      # (id, pos, value)
    vectors: DataFrame      # (id, label, features array<double>)
    lo: int
    n_levels: int
    n: int

    @property
    def union_size(self) -> DataFrame:
        return union_size(self.union)

    def aligned(self) -> DataFrame:
        return align_union(self.cells, self.union)


def reduce_dimensions(cells: DataFrame, lo: int, n_levels: int, column_k: int = defaults.COLUMN_K,
                      n: int = defaults.KEPT_PER_LEVEL, order: str = "name", roles: DataFrame | None = None,
                      materialize: bool = True) -> Reduction:
    """``cells``: unique ``(id, label, level, motion, value)``, levels
    ``lo .. lo + n_levels - 1`` (every id present at every level).
    ``roles (id, label)``: all ids, if already known (else derived from the
    cells).  With ``materialize`` the cells (bucketed by id), the column histograms (and columns
    kept by cost) are written once to the shared checkpoint folder.  With the default order
    the vectors depend on no per-column program."""
    if column_k <= 0:
        raise ValueError(f"number of clusters must be positive, got {column_k}")
    if n <= 0:
        raise ValueError(f"number of kept dimensions must be positive, got {n}")
    if materialize:
        cells, _ = stage_bucketed(cells, "cells", "id")
    if roles is None:
        roles = cells.select("id", "label").distinct()
    n_roles = roles.agg(F.count(F.lit(1))).scalar()
    union = motion_union(cells)
    hist = column_histogram(cells, n_roles)
    if materialize:
        hist = stage_table(hist, "histogram")
    distinct = column_distinct(hist)
    costs = column_cost(hist, column_k)
    if order == "name":
        # the choice needs distinct values only; costs are added to the kept columns for the report
        chosen = kept_columns(informative_columns(distinct, column_k), n, order)
        paid = column_cost(hist.join(chosen.select("level", "motion"), ["level", "motion"], "left_semi"), column_k)
        kept = chosen.join(paid.select("level", "motion", "cost"), ["level", "motion"]).select("level", "rank", "motion", "cost")
    else:
        chosen = kept = kept_columns(informative_columns(costs, column_k), n, order)
        if materialize:
            chosen = kept = stage_table(kept, "kept")
    red = reduced_cells(cells, chosen, lo, n)
    vectors = assemble_vectors(red, roles, n_levels * n)
    return Reduction(cells, n_roles, roles, union, hist, distinct, costs, kept, red, vectors, lo, n_levels, n)
