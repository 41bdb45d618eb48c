"""Bisecting fits in shared passes: Spark ML's trees in few jobs, whatever the partitions and copies are."""

import importlib

import numpy as np
import pytest
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.functions import array_to_vector

from rolevec.operators import bisecting
from rolevec.operators.bisecting import bisecting_fits
from rolevec.operators.cluster import fit_predict

sweep_plan = importlib.import_module("rolevec.plans.sweep")
RNG = np.random.default_rng(11)
# uneven: of equally large clusters Spark ML takes those that its hash table lists first
X = np.concatenate([RNG.normal(c, 1.0, (n, 3)) for c, n in ((1.0, 60), (9.0, 50), (30.0, 30), (45.0, 17))])


def points_of(spark, rows, parts=1):
    df = spark.createDataFrame([(k, k % 2, list(map(float, x))) for k, x in enumerate(rows)], "id long, label int, v array<double>")
    return df.select("id", "label", array_to_vector("v").alias("features")).repartition(parts, "id").sortWithinPartitions("id")


def predictions(df):
    return [r.prediction for r in df.orderBy("id").collect()]


def test_a_bisecting_fit_has_few_jobs(spark):
    """Spark ML's fit makes 100 passes a level: over 200 jobs here."""
    points = points_of(spark, X).cache()
    spark.sparkContext.setJobGroup("bisecting-passes", "")
    fit_predict(points, "bkm", 4)
    sweep_plan.sweep(points, "bkm", 3, 4, 2, parallelism=1)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bisecting-passes")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    points.unpersist()
    assert 20 < len(jobs) < 200


def test_trees_are_those_of_spark_ml(spark):
    points = points_of(spark, X).cache()
    fits = [(2, 1), (3, 5), (4, 21)]
    for (k, seed), got in zip(fits, bisecting_fits(points, fits, max_iter=40)):
        want = BisectingKMeans(k=k, maxIter=40, minDivisibleClusterSize=0.01, seed=seed).fit(points)
        assert predictions(got.transform(points)) == predictions(want.transform(points))
        assert np.allclose(got.clusterCenters(), want.clusterCenters())
        assert got.summary.trainingCost == pytest.approx(want.summary.trainingCost)
    # a limit on the passes is kept, too
    cut = bisecting_fits(points, [(3, 5)], max_iter=2)[0]
    want = BisectingKMeans(k=3, maxIter=2, minDivisibleClusterSize=0.01, seed=5).fit(points)
    assert np.allclose(cut.clusterCenters(), want.clusterCenters())
    points.unpersist()


def test_fits_share_passes_and_partitions_do_not_matter(spark, monkeypatch):
    passes = []
    real = bisecting._pass
    monkeypatch.setattr(bisecting, "_pass", lambda b, t: (passes.append(len(t)), real(b, t))[1])
    monkeypatch.setattr(bisecting, "FITS_PER_TASK", 1)
    monkeypatch.setattr(bisecting, "PIECE", 30)
    fits = [(2, 1), (5, 2), (3, 1)]
    whole = bisecting_fits(points_of(spark, X, 1), fits)
    together = len(passes)
    alone = []
    for k, seed in fits:
        passes.clear()
        parted = bisecting_fits(points_of(spark, X, 7), [(k, seed)])[0]
        alone.append(len(passes))
        assert predictions(parted.transform(points_of(spark, X))) == predictions(whole[fits.index((k, seed))].transform(points_of(spark, X)))
    assert together == max(alone)


def test_copies_stay_together_and_no_cluster_is_empty(spark):
    rows = [x for x in ([1.0, 2.0], [1.0, 2.1], [50.0, 2.0]) for _ in range(9)]
    points = points_of(spark, rows, 4)
    fitted, out = fit_predict(points, "bkm", 6, min_divisible=1)
    assert len(fitted.clusterCenters()) == 3 and fitted.summary.trainingCost == pytest.approx(0.0)
    got = predictions(out)
    assert [len(set(got[i:i + 9])) for i in (0, 9, 18)] == [1, 1, 1] and sorted(set(got)) == [0, 1, 2]
    # clusters that are too small aren't split
    assert out.sparkSession is spark and len(fit_predict(points, "bkm", 6, min_divisible=19)[0].clusterCenters()) == 2


@pytest.mark.parametrize("bad", [[float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1.0]])
def test_points_without_a_place_are_refused(spark, bad):
    with pytest.raises(Exception, match="vectors must"):
        bisecting_fits(points_of(spark, [*X[:5], bad]), [(2, 1)])
    with pytest.raises(ValueError, match="two clusters"):
        bisecting_fits(points_of(spark, X[:5]), [(1, 1)])
