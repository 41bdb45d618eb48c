import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rolevec.operators.colcost import optimal_sse


def brute(values, weights, k):
    order = np.argsort(values)
    v = np.asarray(values, float)[order]
    w = np.asarray(weights, float)[order]
    d = len(v)
    if d <= k:
        return 0.0
    best = np.inf
    for cuts in itertools.combinations(range(1, d), k - 1):
        bounds = (0, *cuts, d)
        tot = 0.0
        for a, b in zip(bounds, bounds[1:]):
            mu = np.dot(w[a:b], v[a:b]) / w[a:b].sum()
            tot += float(np.dot(w[a:b], (v[a:b] - mu) ** 2))
        best = min(best, tot)
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 100), st.integers(1, 50)), min_size=1, max_size=10,
                unique_by=lambda t: t[0]),
       st.integers(1, 6))
def test_optimal_sse_equals_brute_force(pairs, k):
    vals = np.array([p[0] * 100.0 / 7 for p in pairs])
    wts = np.array([p[1] for p in pairs], float)
    assert optimal_sse(vals, wts, k) == pytest.approx(brute(vals, wts, k), rel=1e-9, abs=1e-7)


def test_zero_iff_at_most_k_values():
    rng = np.random.default_rng(0)
    for d in range(1, 12):
        vals = np.sort(rng.choice(1000, size=d, replace=False)).astype(float)
        wts = rng.integers(1, 9, size=d).astype(float)
        c = optimal_sse(vals, wts, 5)
        assert (c == 0.0) == (d <= 5)
        assert c >= 0.0


def test_large_column_is_fast_and_monotone_in_k():
    rng = np.random.default_rng(1)
    vals = np.unique(rng.normal(50, 20, size=20000).round(3))
    wts = rng.integers(1, 100, size=vals.size).astype(float)
    costs = [optimal_sse(vals, wts, k) for k in (2, 3, 5, 8)]
    assert all(a >= b for a, b in zip(costs, costs[1:]))


def test_never_above_spark_ml_kmeans(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(7)
    for trial in range(3):
        raw = rng.integers(0, 9, size=300).astype(float) * 12.5
        df = spark.createDataFrame([(Vectors.dense([x]),) for x in raw], ["features"])
        model = KMeans(k=5, maxIter=20, seed=22).fit(df)
        ml_cost = model.summary.trainingCost
        vals, counts = np.unique(raw, return_counts=True)
        ours = optimal_sse(vals, counts.astype(float), 5)
        assert ours <= ml_cost + 1e-6
        assert (ours == 0.0) == (vals.size <= 5)


def test_bounded_histogram_by_rank_error(spark):
    """At most bins + 1 rows whatever the number of roles, exact weights, ranks and cost within bounds."""
    from rolevec.operators.colcost import HISTOGRAM_BINS, bounded_histogram, column_cost, column_histogram

    rows_of = {}
    for n in (2_000, 40_000):
        cells = spark.range(n).select("id", F.lit(2).alias("level"), F.lit("m").alias("motion"), (F.pow(F.rand(3), 2) * 100).alias("value")).cache()
        hist = bounded_histogram(cells, F.lit(n + 500)).toPandas().sort_values("value")
        rows_of[n] = len(hist)
        assert len(hist) <= HISTOGRAM_BINS + 1 and abs(hist["w"].sum() - (n + 500)) < 1e-6 and hist[hist["value"] == 0.0]["w"].iloc[0] >= 500
        true = np.sort(cells.select("value").toPandas()["value"].to_numpy())
        rank = np.searchsorted(true, hist["value"].to_numpy()[1:]) / n
        assert np.abs(rank - (np.arange(len(rank)) + 0.5) / len(rank)).max() < 0.02
        exact = column_cost(column_histogram(cells, F.lit(n + 500)), 5).first().cost
        near = column_cost(bounded_histogram(cells, F.lit(n + 500)), 5).first().cost
        assert abs(near - exact) < 0.05 * exact
    assert rows_of[2_000] == rows_of[40_000]


def test_few_values_keep_the_zero_set(spark):
    from rolevec.operators.colcost import bounded_histogram, column_cost

    cells = spark.createDataFrame([(i, 2, "m", float(i % 4) * 10) for i in range(1000)], "id long, level int, motion string, value double")
    assert column_cost(bounded_histogram(cells, F.lit(1000)), 5).first().cost == 0.0
