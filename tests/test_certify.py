"""Lloyd's iterations, certificates that notice what is wrong, and the sweep's ledger."""

import importlib

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from rolevec.operators.certify import certificate, lloyd, model_centres
from rolevec.operators.cluster import assign_centres, fit_predict
from rolevec.operators.evaluate import round_checks, sweep_checks
from rolevec.plans.two_round import two_round_clustering

sweep_plan = importlib.import_module("rolevec.plans.sweep")

RNG = np.random.default_rng(4)
X = np.concatenate([RNG.normal(c, 1.0, (40, 3)) for c in (0.0, 4.0, 9.0)])


@pytest.fixture(scope="module")
def points(spark):
    rows = [(k, int(k % 9 == 0), x.tolist()) for k, x in enumerate(X)]
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    return df.select("id", "label", array_to_vector("v").alias("features")).repartition(4).cache()


def centres_of(spark, rows):
    return spark.createDataFrame([(j, list(map(float, c))) for j, c in enumerate(rows)], "cluster int, centre array<double>")


def numpy_lloyd(start, rounds):
    c = np.array(start, float)
    for _ in range(rounds):
        near = ((X[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([X[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
    return ((X[:, None] - c[None]) ** 2).sum(2).argmin(1), c


@pytest.mark.parametrize("rounds", [1, 3, 50])
def test_lloyd_against_numpy(spark, points, rounds):
    start = np.concatenate([X[:3], [[500.0, 500.0, 500.0]]])  # the last one stays without points
    assigned, centres = lloyd(points, centres_of(spark, start), rounds)
    want, c = numpy_lloyd(start, rounds)
    assert {r.id: r.prediction for r in assigned.collect()} == dict(enumerate(want.tolist()))
    got = {r.cluster: r.centre for r in centres.collect()}
    assert np.allclose([got[j] for j in range(4)], c) and got[3] == [500.0] * 3


def test_certificate_of_a_fit_and_of_what_is_no_fit(spark, points):
    fitted, out = fit_predict(points, "km", 3)
    n_bad = int(sum(k % 9 == 0 for k in range(len(X))))
    assigned, centres = lloyd(points, model_centres(points, fitted))
    good = certificate(assigned, centres, n_bad).first()
    total = ((X - X.mean(0)) ** 2).sum()
    assert (good.clusters, good.n, good.n_bad, good.strays) == (3, len(X), n_bad, 0)
    assert good.drift < 1e-9 and abs(good.recall_sum - 1) < 1e-12
    assert abs(good.total - total) < 1e-6 and abs(good.mass - X.sum()) < 1e-6
    assert abs(good.sse - fitted.summary.trainingCost) < 1e-3 * good.sse
    # centres moved: neither means nor (for some points) nearest
    moved = centres.withColumn("centre", F.when(F.col("cluster") == 0, F.transform("centre", lambda x: x + 3.0)).otherwise(F.col("centre")))
    bad = certificate(assigned, moved, n_bad).first()
    assert bad.strays > 0 and abs(bad.drift - 3.0) < 1e-9 and abs(bad.total - total) > 1 and abs(bad.mass - X.sum()) > 1
    # a few points in the wrong cluster
    wrong = assigned.withColumn("prediction", F.when(F.col("id") < 4, (F.col("prediction") + 1) % 3).otherwise(F.col("prediction")))
    off = certificate(wrong, centres, n_bad).first()
    assert off.strays == 4 and off.drift > 1e-3


def test_certificate_of_equal_points(spark):
    df = spark.createDataFrame([(k, k % 2, [1.0, 2.0]) for k in range(6)], "id long, label int, v array<double>").select("id", "label", array_to_vector("v").alias("features"))
    fitted, out = fit_predict(df, "km", 3)
    got = certificate(out, model_centres(df, fitted), 3).first()
    assert fitted is None and (got.clusters, got.n, got.strays, got.drift, got.total) == (1, 6, 0, 0.0, 0.0)


def test_round_checks(points):
    t = two_round_clustering(points, "bkm", 3)
    got = round_checks(t).first()
    assert (got.n, got.clusters, got.recall_sum) == (len(X), 3, 1.0)
    assert got.unlisted == got.outside == got.lost == got.better == got.marked == got.detected_gap == 0 and got.recall_gap == 0.0
    # a checklist that marks someone else is noticed
    t.checklist = t.checklist.withColumn("prediction", F.when(F.col("id") == 0, 1 - F.col("prediction")).otherwise(F.col("prediction")))
    assert round_checks(t).first().marked == 1


def test_interrupted_sweep_fits_only_the_rest(points, tmp_out, monkeypatch):
    ledger = f"{tmp_out}/ledger"
    fits = []
    real = sweep_plan.fit_predict

    def counted(df, model, k, **kw):
        fits.append((k, kw["seed"]))
        if len(fits) > 6:
            raise KeyboardInterrupt  # half-way: three fits of two rounds each are done
        return real(df, model, k, **kw)

    monkeypatch.setattr(sweep_plan, "fit_predict", counted)
    with pytest.raises(KeyboardInterrupt):
        sweep_plan.sweep(points, "km", 2, 4, 2, parallelism=1, ledger=ledger)
    spark = points.sparkSession
    before = sweep_plan.read_ledger(spark, ledger)
    done = {(r.k, r["round"]) for r in before.collect()}
    assert done == {(2, 1), (2, 2), (3, 1)}
    fits.clear()
    monkeypatch.setattr(sweep_plan, "fit_predict", lambda df, model, k, **kw: (fits.append((k, kw["seed"])), real(df, model, k, **kw))[1])
    out = sweep_plan.sweep(points, "km", 2, 4, 2, parallelism=1, ledger=ledger)
    assert {(k, s) for k, s in fits if k != 2 or s > 23} >= {(3, 23), (4, 22), (4, 23)}
    assert len(fits) == 6  # three fits, two rounds of clustering each
    whole = sweep_plan.sweep(points, "km", 2, 4, 2, parallelism=1)
    key = lambda r: (r["k"], r["round"], r["stage"], r["prediction"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, whole.collect())) and len({key(r) for r in out.collect()}) == out.count()
    checks = sweep_checks(out).collect()
    assert len(checks) == 6 and all(r.n == len(X) and r.n_gap == r.bad_gap == 0 and r.recall_gap == 0.0 and r.clusters == r.k for r in checks)
    # nothing left to fit; a wider sweep adds to it; other points are refused
    fits.clear()
    sweep_plan.sweep(points, "km", 2, 3, 2, ledger=ledger)
    assert fits == []
    sweep_plan.sweep(points, "km", 2, 2, 3, ledger=ledger)
    assert {s for _, s in fits} == {24}
    with pytest.raises(ValueError, match="other points"):
        sweep_plan.sweep(points.where("id > 3"), "km", 2, 2, 1, ledger=ledger)
