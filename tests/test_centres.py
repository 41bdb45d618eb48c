"""The block distance kernel against a loop over vectors."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolevec.operators.cluster import assign_centres, local_centres, nearest_of_block
from rolevec.operators.colcost import cohesion_separation


def brute(vector, centres):
    """(cluster, squared distance) of the nearest centre, or None."""
    best = None
    for cluster, c in sorted(centres, key=lambda x: x[0]):
        if vector is None or None in vector or len(vector) != len(c):
            continue
        d = 0.0
        for x, y in zip(vector, c):
            d += (x - y) * (x - y)
        if best is None or (math.isnan(d), d) < (math.isnan(best[1]), best[1]):
            best = (cluster, d)
    return best


def test_kernel_equals_a_loop_to_the_last_bit():
    rng = random.Random(5)
    centres = [(j, [rng.uniform(-1, 1) for _ in range(7)]) for j in range(4)] + [(9, [0.0] * 3)]
    vectors = [[rng.uniform(-1, 1) for _ in range(7)] for _ in range(300)] + [None, [], [1.0] * 7, [0.5] * 3, [None] + [0.0] * 6, [1.0] * 5]
    # slices of a longer block have an offset
    block = pa.array([[7.0] * 7, *vectors, [8.0] * 7], pa.list_(pa.float64()))[1:-1]
    nearest, least, found = nearest_of_block(block, centres)
    want = [brute(v, centres) for v in vectors]
    assert [(int(a), float(b)) if ok else None for a, b, ok in zip(nearest, least, found)] == want


def test_ties_go_to_the_lower_cluster_and_nan_is_beyond_all():
    vectors = pa.array([[0.0], [float("nan")], [3.0]], pa.list_(pa.float64()))
    nearest, least, found = nearest_of_block(vectors, [(1, [float("nan")]), (2, [1.0]), (3, [-1.0])])
    assert nearest.tolist() == [2, 1, 2] and found.all() and least[0] == 1.0 and math.isnan(least[1])


def test_assignment_keeps_rows_and_takes_floats(spark):
    rows = [(1, [0.0, 0.1]), (2, None), (3, [5.0, 5.0]), (4, [1.0]), (5, [2.5, None]), (5, [5.0, 5.0])]
    points = spark.createDataFrame(rows, "id long, features array<float>").withColumn("dist", F.lit("mine"))
    centres = spark.createDataFrame([(4, [5.0, 5.0]), (2, [0.0, 0.0])], "cluster int, centre array<double>")
    got = assign_centres(points, centres)
    assert got.columns == ["id", "features", "dist", "dist2", "prediction"]
    assert sorted((r.id, r.prediction) for r in got.collect() if r.prediction is not None) == [(1, 2), (3, 4), (5, 4)]
    assert got.where("prediction is null and dist2 is null").count() == 3
    out = cohesion_separation(got.where("dist2 is not null"), centres).first()
    assert out.sse == pytest.approx(float(0.1) ** 2, rel=1e-6) and out.ssb == pytest.approx(12.5)
    # the k rows may be collected already; no point gives no sum
    assert cohesion_separation(assign_centres(points.limit(0), local_centres(centres)), local_centres(centres)).first() == (None, None)
    assert assign_centres(points, []).where("prediction is not null").isEmpty()
