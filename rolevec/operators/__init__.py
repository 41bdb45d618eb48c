"""DataFrame operators: every function takes and returns DataFrames."""

from rolevec.operators.align import align_union, motion_union, union_size
from rolevec.operators.cluster import (
    assign_centres,
    centres_from_assignment,
    fit_predict,
)
from rolevec.operators.colcost import (
    cohesion_separation,
    column_cost,
    column_histogram,
    informative_columns,
    optimal_sse,
    sq_dist,
)
from rolevec.operators.counts import (
    covered_roles,
    coverage_filter,
    explode_sequences,
    motion_counts,
    role_count,
    role_count_value,
    trim_levels,
)
from rolevec.operators.evaluate import (
    best_cluster,
    checklist,
    cluster_summary,
    count_positives,
    evaluation_report,
    suspicious_rows,
)
from rolevec.operators.reduce import assemble_vectors, kept_columns, reduced_cells, to_vector
from rolevec.operators.scaling import motion_ranges, scale_counts, scale_value
from rolevec.operators.topk import (
    densify_dictionary,
    level_grid,
    rank_topk,
    sparse_cells,
    topk_motions,
    topk_padded,
    unaligned_vectors,
)

__all__ = [name for name in dir() if not name.startswith("_")]
