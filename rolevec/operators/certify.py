"""Lloyd's iterations from given centres, and certificates of a clustering.

A certificate holds for any start of the fit and can be restated from the points alone:

* every point lies nearest to its own centre (``strays`` counts those that don't), and every
  centre is the mean of its points (``drift``): a fixed point of the iterations;
* ``total`` = squared distances inside the clusters + those of the centres to the overall
  mean, weighted by size.  It equals the points' own total sum of squares exactly when the
  centres are means;
* ``mass`` = size-weighted sum of all centre components = sum of all components;
* sizes, known cases and recalls add up over the clusters.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from rolevec import defaults
from rolevec.operators.cluster import assign_centres, centres_from_assignment
from rolevec.operators.colcost import sq_dist
from rolevec.session import stage_table

SAME = 1e-9  # distances that differ by less (relatively) are equal


def as_arrays(points: DataFrame, features_col: str = "features") -> DataFrame:
    """Vector features as arrays of doubles."""
    if isinstance(points.schema[features_col].dataType, ArrayType):
        return points
    return points.withColumn(features_col, vector_to_array(features_col))


def model_centres(points: DataFrame, fitted, features_col: str = "features") -> DataFrame:
    """``(cluster, centre)`` of a fitted model, k rows; of no model (all points equal), the point."""
    if fitted is None:
        one = as_arrays(points, features_col).select(F.lit(0).alias("cluster"), F.col(features_col).alias("centre"))
        return stage_table(one.groupBy("cluster").agg(F.min("centre").alias("centre")), "centres")
    rows = [(j, [float(x) for x in c]) for j, c in enumerate(fitted.clusterCenters())]
    return points.sparkSession.createDataFrame(rows, "cluster int, centre array<double>")


def lloyd(points: DataFrame, centres: DataFrame, max_iter: int = defaults.FINAL_MAX_ITER,
          features_col: str = "features") -> tuple[DataFrame, DataFrame]:
    """``(points + prediction and dist2, centres)`` after Lloyd's iterations from the given
    ``centres (cluster, centre)``.

    An iteration is one pass with one vector per cluster and task before the exchange; the
    centres of each are a written table of k rows.  A centre without points stays where it
    is.  Ends when no centre moves."""
    if max_iter <= 0:
        raise ValueError(f"number of iterations must be positive, got {max_iter}")
    arrays = as_arrays(points, features_col)
    for _ in range(max_iter):
        means = centres_from_assignment(assign_centres(arrays, centres, features_col), "prediction", features_col)
        moved = (centres.select("cluster", F.col("centre").alias("_old")).join(means, "cluster", "left")
                 .select("cluster", F.coalesce("centre", "_old").alias("centre"), "_old"))
        moved = stage_table(moved, "centres")
        centres = moved.select("cluster", "centre")
        if moved.where(sq_dist(F.col("centre"), F.col("_old")) > 1e-18).isEmpty():
            break
    return assign_centres(arrays, centres, features_col), centres


def certificate(assigned: DataFrame, centres: DataFrame, n_bad: int, features_col: str = "features") -> DataFrame:
    """One row ``(clusters, n, n_bad, recall_sum, strays, drift, sse, between, total, mass)``.

    ``assigned`` holds the points with their ``prediction``; ``n_bad`` is the number of known
    cases that recalls refer to.  One pass over the points; what follows has k rows."""
    arrays = as_arrays(assigned, features_col).select("label", F.col(features_col).alias("_x"), F.col("prediction").cast("int").alias("cluster"))
    near = assign_centres(arrays, centres, "_x").select("label", "_x", "cluster", F.col("dist2").alias("_near"))
    own = near.join(F.broadcast(centres.select(F.col("cluster").cast("int").alias("cluster"), "centre")), "cluster", "left")  # k rows
    dist = own.select("label", "_x", "cluster", "_near", sq_dist(F.col("_x"), F.col("centre")).alias("_own"))
    per = dist.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("bad"), F.sum("_own").alias("sse"),
        F.count_if(F.col("_own") > F.col("_near") + SAME * (1 + F.col("_near"))).alias("strays"),
        vector_to_array(Summarizer.mean(array_to_vector("_x"))).alias("mean"))
    per = stage_table(per.join(F.broadcast(centres.select(F.col("cluster").cast("int").alias("cluster"), "centre")), "cluster"), "certificate")
    middle = (per.select("n", F.posexplode("centre").alias("pos", "x")).groupBy("pos").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("x"))
              .agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("_m")).select(F.transform("_m", lambda s: s["x"])).scalar())
    apart = F.array_max(F.transform(F.arrays_zip("mean", "centre"), lambda z: F.abs(z["mean"] - z["centre"])))
    weight = F.aggregate("centre", F.lit(0.0), lambda s, x: s + x)
    per = per.select("*", middle.alias("_middle"))
    out = per.agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("n"), F.sum("bad").alias("n_bad"),
        F.try_divide(F.sum("bad").cast("double"), F.lit(float(n_bad))).alias("recall_sum"),
        F.sum("strays").alias("strays"), F.max(apart).alias("drift"), F.sum("sse").alias("sse"),
        F.sum(F.col("n") * sq_dist(F.col("centre"), F.col("_middle"))).alias("between"), F.sum(F.col("n") * weight).alias("mass"))
    return out.select("clusters", "n", "n_bad", "recall_sum", "strays", "drift", "sse", "between", (F.col("sse") + F.col("between")).alias("total"), "mass")
