"""Column scores: how well a single aligned column clusters into ``k`` groups.

A column is one (level, motion) of the aligned view: one value per role, 0.0
for roles that lack the motion.  Its score is the within-cluster sum of
squares of a ``k``-means clustering of those values.  The values are
one-dimensional, so the optimal clustering is a partition of the sorted
distinct values into ``k`` intervals and is computed exactly:

1. ``column_histogram``: distinct values and their weights per column, from
   the sparse cells (partial aggregation; the implicit zeros are one extra row
   per column).  A column's histogram has at most as many rows as the column
   has distinct values, whatever the number of roles.
2. ``column_distinct``: distinct values per column, which decide whether a column is
   informative.  Keeping columns by name needs no more.
3. ``column_cost``: for the columns whose cost is asked for, each histogram goes
   through a weighted interval dynamic program in ``applyInPandas``
   (divide-and-conquer over the monotone optimal cut, O(k * d * log d) for d distinct
   values, no pairwise expansion).  A task holds one column's distinct values.
4. ``column_cost_kmeans``: the same score by weighted k-means iterations over the
   histograms of all columns at once; work is split by histogram rows, not by column.

A column with at most ``k`` distinct values costs exactly 0; only columns with
a nonzero cost are informative.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolevec import defaults
from rolevec.operators.cluster import local_centres
from rolevec.session import stage_table

# The grouped pandas function below runs in Python workers; pickling this
# module by value ships its code with the task, so executors need neither an
# installed package nor extra files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HISTOGRAM_BINS = 256  # values that stand for a column's held ones in the bounded form
SKETCH_K = 800

COST_SCHEMA = "level int, motion string, n_distinct long, cost double"


def column_histogram(cells: DataFrame, n_roles: Column) -> DataFrame:
    """``(level, motion, value, w)`` with ``sum(w) = n_roles`` per column.

    Per-value counts, plus one row per column with the implicit zeros of the roles that
    lack the motion; two aggregations that combine before the exchange.  No list of a
    column's values is built."""
    held = cells.groupBy("level", "motion", "value").agg(F.count(F.lit(1)).alias("w"))
    zeros = (cells.groupBy("level", "motion").agg(F.count(F.lit(1)).alias("_held"))
             .select("level", "motion", F.lit(0.0).alias("value"), (n_roles - F.col("_held")).alias("w")))
    return (held.unionByName(zeros).groupBy("level", "motion", "value").agg(F.sum("w").alias("w"))
            .where(F.col("w") > 0))


def bounded_histogram(cells: DataFrame, n_roles: Column, bins: int = HISTOGRAM_BINS, sketch_k: int = SKETCH_K) -> DataFrame:
    """``(level, motion, value, w)`` with at most ``bins + 1`` rows a column, however many roles.

    A column's held values go through a KLL sketch, which merges before and after the
    exchange; the quantiles in the middle of ``bins`` equal shares stand for them, and the
    implicit zeros are a value of their own, with their exact weight.  A quantile's rank is
    off by about 2.3 / ``sketch_k`` ** 0.9 of the held values (0.5 % for 800) plus half a
    share."""
    if bins <= 0:
        raise ValueError(f"number of bins must be positive, got {bins}")
    ranks = F.array(*[F.lit((i + 0.5) / bins) for i in range(bins)])
    per = cells.groupBy("level", "motion").agg(F.kll_sketch_agg_double(F.col("value").cast("double"), sketch_k).alias("_s"), F.count("value").alias("_held"))
    held = (per.select("level", "motion", "_held", F.explode(F.kll_sketch_get_quantile_double("_s", ranks)).alias("value"))
            .groupBy("level", "motion", "value").agg((F.count(F.lit(1)) * F.max("_held") / F.lit(float(bins))).alias("w")))
    zeros = per.select("level", "motion", F.lit(0.0).alias("value"), (n_roles - F.col("_held")).cast("double").alias("w"))
    return held.unionByName(zeros).groupBy("level", "motion", "value").agg(F.sum("w").alias("w")).where(F.col("w") > 0)


def column_distinct(histogram: DataFrame) -> DataFrame:
    """``(level, motion, n_distinct)``: a plain aggregate, all that the choice of informative
    columns by name needs."""
    return histogram.groupBy("level", "motion").agg(F.count(F.lit(1)).alias("n_distinct"))


def optimal_sse(values: np.ndarray, weights: np.ndarray, k: int) -> float:
    """Least weighted SSE of splitting 1-D points into ``k`` clusters."""
    order = np.argsort(values, kind="stable")
    v = np.asarray(values, dtype=float)[order]
    w = np.asarray(weights, dtype=float)[order]
    d = v.size
    if d <= k:
        return 0.0
    x = v - np.dot(w, v) / w.sum()  # centred: keeps the prefix sums small
    pw = np.concatenate(([0.0], np.cumsum(w)))
    p1 = np.concatenate(([0.0], np.cumsum(w * x)))
    p2 = np.concatenate(([0.0], np.cumsum(w * x * x)))

    def seg(j: np.ndarray, i: np.ndarray) -> np.ndarray:
        # points j+1 .. i (1-based prefix indices)
        s0 = pw[i] - pw[j]
        s1 = p1[i] - p1[j]
        return np.maximum(p2[i] - p2[j] - s1 * s1 / s0, 0.0)

    idx = np.arange(d + 1)
    prev = np.full(d + 1, np.inf)
    prev[1:] = seg(np.zeros(d, dtype=np.int64), idx[1:])
    for m in range(2, k + 1):
        cur = np.full(d + 1, np.inf)
        ilo, ihi = np.array([m]), np.array([d])
        jlo, jhi = np.array([m - 1]), np.array([d - 1])
        while ilo.size:
            mid = (ilo + ihi) // 2
            top = np.minimum(jhi, mid - 1)
            lens = top - jlo + 1
            starts = np.cumsum(lens) - lens
            owner = np.repeat(np.arange(mid.size), lens)
            j = np.repeat(jlo, lens) + (np.arange(lens.sum()) - np.repeat(starts, lens))
            val = prev[j] + seg(j, mid[owner])
            best = np.minimum.reduceat(val, starts)
            hit = np.flatnonzero(val <= best[owner])
            first = hit[np.unique(owner[hit], return_index=True)[1]]
            opt = j[first]
            cur[mid] = best
            left = ilo <= mid - 1
            right = mid + 1 <= ihi
            ilo, ihi, jlo, jhi = (
                np.concatenate((ilo[left], (mid + 1)[right])),
                np.concatenate(((mid - 1)[left], ihi[right])),
                np.concatenate((jlo[left], opt[right])),
                np.concatenate((opt[left], jhi[right])),
            )
        prev = cur
    return float(prev[d])


def _cost_of_group(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vals = pdf["value"].to_numpy(dtype=float)
        wts = pdf["w"].to_numpy(dtype=float)
        keep = wts > 0
        vals, wts = vals[keep], wts[keep]
        return pd.DataFrame({
            "level": [int(pdf["level"].iloc[0])],
            "motion": [pdf["motion"].iloc[0]],
            "n_distinct": [int(np.unique(vals).size)],
            "cost": [optimal_sse(vals, wts, k)],
        })
    return run


def column_cost(histogram: DataFrame, k: int = defaults.COLUMN_K) -> DataFrame:
    """``(level, motion, n_distinct, cost)`` for every column of the histogram."""
    if k <= 0:
        raise ValueError(f"number of clusters must be positive, got {k}")
    return (histogram.select(F.col("level").cast("int"), "motion", "value", "w")
            .groupBy("level", "motion").applyInPandas(_cost_of_group(k), COST_SCHEMA))


def column_cost_kmeans(histogram: DataFrame, k: int = defaults.COLUMN_K, max_iter: int = defaults.COLUMN_MAX_ITER) -> DataFrame:
    """``(level, motion, n_distinct, cost)`` by Lloyd's iterations instead of the optimum.

    Starts from ``k`` evenly spaced points between a column's smallest and largest value.
    An iteration is one aggregation over (level, motion, cluster) that combines before the
    exchange; columns of any size are spread over all tasks.  Stops when no centre moves.
    At most ``k`` distinct values cost 0.  Never below the optimum of :func:`column_cost`."""
    if k <= 0:
        raise ValueError(f"number of clusters must be positive, got {k}")
    hist = stage_table(histogram.select("level", "motion", F.col("value").cast("double").alias("value"), "w"), "histogram")
    span = hist.groupBy("level", "motion").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    even = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.col("lo") + (F.col("hi") - F.col("lo")) * (j + 0.5) / k)
    centres = stage_table(span.select("level", "motion", even.alias("c")), "column-centres")

    def assigned(c: DataFrame) -> DataFrame:
        far = F.transform("c", lambda x: F.abs(x - F.col("value")))
        return (hist.join(c, ["level", "motion"]).withColumn("_d", far).withColumn("_m", F.array_min("_d"))
                .select("level", "motion", "value", "w", "c", F.array_position("_d", F.col("_m")).cast("int").alias("j"), F.col("_m").alias("d")))

    for _ in range(max_iter):
        near = assigned(centres).groupBy("level", "motion", "j").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("x"), F.first("c").alias("c"))
        moved = near.groupBy("level", "motion").agg(F.map_from_entries(F.collect_list(F.struct("j", "x"))).alias("m"), F.first("c").alias("c"))  # k entries
        new = F.transform("c", lambda x, i: F.coalesce(F.try_element_at(F.col("m"), i + 1), x))
        nxt = stage_table(moved.select("level", "motion", new.alias("c"), F.col("c").alias("before")), "column-centres")
        still = nxt.where(F.exists(F.arrays_zip("c", "before"), lambda z: F.abs(z["c"] - z["before"]) > 1e-9)).isEmpty()
        centres = nxt.drop("before")
        if still:
            break
    cost = assigned(centres).groupBy("level", "motion").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum(F.col("w") * F.col("d") * F.col("d")).alias("cost"))
    return cost.select("level", "motion", "n_distinct", F.when(F.col("n_distinct") <= k, F.lit(0.0)).otherwise(F.col("cost")).alias("cost"))


def informative_columns(costs: DataFrame, k: int = defaults.COLUMN_K) -> DataFrame:
    """Columns with a nonzero cost, i.e. more than ``k`` distinct values
    (``costs``: a table with ``n_distinct``, from any of the functions above)."""
    return costs.where(F.col("n_distinct") > F.lit(k))


def sq_dist(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two numeric arrays."""
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, z: acc + z)


def cohesion_separation(assigned: DataFrame, centres: DataFrame | list) -> DataFrame:
    """One row ``(sse, ssb)`` of a clustering.

    ``assigned`` holds the points with ``prediction`` and ``dist2``; ``centres`` holds
    ``(cluster, centre array<double>)``, k rows (or the list of them).  SSE is the summed
    squared distance of every point to its centre; SSB = sum over non-empty clusters of
    ``share * |centre - m|^2`` where ``m`` is the plain (unweighted) mean of all
    centres.  One aggregation per cluster over the points; the centres' own distances
    are k numbers of the plan."""
    known = [(c, np.asarray(x, dtype=float)) for c, x in local_centres(centres)]
    middle = np.mean([x for _, x in known], axis=0) if known else None
    apart = [F.lit(v) for c, x in known for v in (c, float(np.square(x - middle).sum()))]
    per = assigned.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), F.sum("dist2").alias("_sse"))
    own = F.try_element_at(F.create_map(*apart), F.col("prediction")) if apart else F.lit(None).cast("double")
    # share = n / N with N = sum(n): both sums in one aggregation, no second pass
    out = per.agg(F.sum("_sse").alias("sse"), F.sum(F.col("n").cast("double") * own).alias("_nd"), F.sum("n").alias("_n"))
    return out.select("sse", (F.col("_nd") / F.col("_n").cast("double")).alias("ssb"))
