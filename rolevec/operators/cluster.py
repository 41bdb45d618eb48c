"""Clustering of feature vectors with Spark ML, and assignment to given centres."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolevec import defaults
from rolevec.operators.bisecting import BisectingFit, bisecting_fits

#: Vector components that a task of a fit reads in every pass (8 MB of doubles).
VALUES_PER_TASK = 1 << 20

# tasks get the kernel by value: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _check(model: str, k: int) -> None:
    if model not in defaults.MODELS:
        raise ValueError(f"model must be one of {defaults.MODELS}, got {model!r}")
    if k <= 0:
        raise ValueError(f"number of clusters must be positive, got {k}")


def extent(points: DataFrame, features_col: str = "features") -> tuple[bool, int]:
    """Are all points equal, and how many tasks should a pass over them have?

    Spark ML's k-means|| start fails on equal points, which have exactly one cluster.  One
    pass with partial aggregation: the smallest and the largest vector are equal exactly when
    all are.  Tasks follow the number of vector components, not the session's shuffle
    partitions: a fit makes hundreds of passes."""
    arr = vector_to_array(features_col)
    got = points.agg(F.min(arr).alias("lo"), F.max(arr).alias("hi"), F.sum(F.size(arr)).alias("values")).first()
    return got["lo"] == got["hi"], max(1, -(-(got["values"] or 0) // VALUES_PER_TASK))


def points_coincide(points: DataFrame, features_col: str = "features") -> bool:
    """Are all points equal (:func:`extent`)?"""
    return extent(points, features_col)[0]


def fit_predict(points: DataFrame, model: str = "km", k: int = 5,
                max_iter: int = defaults.FINAL_MAX_ITER, seed: int | None = defaults.FINAL_SEED,
                min_divisible: float = defaults.MIN_DIVISIBLE_SIZE,
                features_col: str = "features", coincide: bool | None = None, fitted: BisectingFit | None = None):
    """Fit k-means (``km``, Spark ML) or bisecting k-means (``bkm``,
    :mod:`rolevec.operators.bisecting`) and predict.

    Returns ``(fitted model, points + prediction int)``; the model is None
    when all points coincide.  ``points`` needs a vector column ``features_col``.  The fit
    runs on the points :func:`in_order`; a caller who fits the same points many times puts
    them in order once and says whether they ``coincide``.  One who has many bisecting fits
    makes them together (:func:`bisecting_fits`) and passes each as ``fitted``."""
    _check(model, k)
    ordered = points
    if coincide is None:
        coincide, tasks = extent(points, features_col)
        ordered = in_order(points, tasks, features_col)
    if coincide:
        return None, points.withColumn("prediction", F.lit(0).cast("int"))
    if model == "bkm":
        fitted = fitted or bisecting_fits(ordered, [(k, seed)], max_iter, min_divisible, features_col)[0]
    else:
        est = KMeans(k=k, maxIter=max_iter, initMode="k-means||", featuresCol=features_col,
                     predictionCol="prediction")
        if seed is not None:
            est = est.setSeed(int(seed))
        fitted = est.fit(ordered)
    out = fitted.transform(points).withColumn("prediction", F.col("prediction").cast("int"))
    return fitted, out


def in_order(points: DataFrame, tasks: int, features_col: str = "features") -> DataFrame:
    """Points dealt to ``tasks`` (see :func:`extent`) and sorted by id: a seeded fit draws its start
    by a row's place, and the files of a staged table are read in no fixed order.  Dealt by id and
    vector, so rows without an id or of the same one are spread, too."""
    if "id" not in points.columns:
        return points.repartition(tasks)
    return points.repartition(tasks, "id", features_col).sortWithinPartitions("id")


def centres_from_assignment(points: DataFrame, cluster_col: str, features_col: str = "features") -> DataFrame:
    """``(cluster, centre array<double>)``: the mean of every cluster's points, one
    vector per cluster and task before the exchange."""
    per = (points.select(F.col(cluster_col).cast("int").alias("cluster"), array_to_vector(features_col).alias("_v"))
           .groupBy("cluster").agg(Summarizer.mean(F.col("_v")).alias("_m")))
    return per.select("cluster", vector_to_array("_m").alias("centre"))


def local_centres(centres: DataFrame | list) -> list[tuple[int, list[float] | None]]:
    """``(cluster, centre)`` in order of the cluster: the k rows of a clustering, collected
    unless they already are."""
    if isinstance(centres, list):
        return sorted(centres, key=lambda c: c[0])
    rows = centres.select(F.col("cluster").cast("int").alias("cluster"), F.col("centre").cast("array<double>").alias("centre")).collect()
    return sorted(((r["cluster"], r["centre"]) for r in rows), key=lambda c: c[0])


def nearest_of_block(vectors: pa.Array, centres: list[tuple[int, list[float] | None]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per vector of an Arrow list array: nearest cluster, squared distance, and whether there is one.

    Distances add up dimension by dimension over the whole block, so they equal those of a
    loop over a vector to the last bit.  A distance that isn't a number is beyond all others;
    a null vector, one with a null component, or one of another width than every centre has
    none.  Ties go to the first centre."""
    n = len(vectors)
    nearest, least, found = np.zeros(n, np.int32), np.zeros(n), np.zeros(n, bool)
    sizes = pc.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
    for width in {len(c) for _, c in centres if c is not None and None not in c}:
        rows = np.flatnonzero(sizes == width)
        if len(rows) == 0:
            continue
        flat = vectors.take(pa.array(rows)).flatten().cast(pa.float64())
        block = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(len(rows), width)
        if flat.null_count:
            whole = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(rows), width).all(axis=1)
            rows, block = rows[whole], block[whole]
        columns = np.ascontiguousarray(block.T)
        for cluster, centre in centres:
            if centre is None or None in centre or len(centre) != width:
                continue
            far = np.zeros(len(rows))
            for column, x in zip(columns, centre):
                step = column - x
                far += step * step
            closer = ~found[rows] | (far < least[rows]) | (np.isnan(least[rows]) & ~np.isnan(far))
            at = rows[closer]
            nearest[at], least[at], found[at] = cluster, far[closer], True
    return nearest, least, found


def assign_centres(points: DataFrame, centres: DataFrame | list, features_col: str = "features") -> DataFrame:
    """Nearest centre per point: adds ``prediction`` (lowest cluster on ties)
    and ``dist2``.  ``centres (cluster, centre array)`` has k rows, which travel with the
    task (or come as a list from :func:`local_centres`); vectors are scored in Arrow
    blocks, a matrix at a time, and no row moves."""
    known = local_centres(centres)

    @F.arrow_udf("struct<prediction:int,dist2:double>")
    def near(vectors: pa.Array) -> pa.Array:
        nearest, least, found = nearest_of_block(vectors, known)
        return pa.StructArray.from_arrays([pa.array(nearest, pa.int32(), mask=~found), pa.array(least, pa.float64(), mask=~found)], names=["prediction", "dist2"])

    return (points.withColumn("_near", near(F.col(features_col)))
            .withColumns({"dist2": F.col("_near.dist2"), "prediction": F.col("_near.prediction")}).drop("_near"))
