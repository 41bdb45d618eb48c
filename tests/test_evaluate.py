"""Summaries, the suspicious cluster, checklist and the two-round plan."""

import pytest
from pyspark.sql import functions as F

from rolevec.catalog.queries import _points, _stage2
from rolevec.operators.cluster import assign_centres, centres_from_assignment, fit_predict
from rolevec.operators.colcost import cohesion_separation
from rolevec.operators.evaluate import best_cluster, checklist, cluster_summary, count_positives
from rolevec.operators.reduce import to_vector
from rolevec.plans.sweep import sweep
from rolevec.plans.two_round import two_round_clustering
from rolevec.session import checkpointed

SF = "/root/testdata/sf0.001"


def test_summary_invariants(spark):
    pts = _points(spark, SF).withColumn("prediction", F.pmod("id", F.lit(4)).cast("int"))
    n_bad = count_positives(pts).first()["n_bad"]
    s = cluster_summary(pts, F.lit(n_bad)).collect()
    assert sum(r.n for r in s) == pts.count()
    assert sum(r.recall for r in s) == pytest.approx(1.0)
    assert all(r.n_good + r.n_bad == r.n for r in s)
    best = best_cluster(cluster_summary(pts, F.lit(n_bad))).first()
    assert best.recall == max(r.recall for r in s)


def test_zero_positives_gives_null_recall(spark):
    pts = spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "id long, label int, prediction int")
    s = cluster_summary(pts, F.lit(0)).collect()
    assert all(r.recall is None for r in s)


def test_checklist_marks_only_suspicious(spark):
    a = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1)], "id long, label int, prediction int")
    sus = a.where("prediction = 0")
    got = {r.id: r.prediction for r in checklist(a, sus).collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_centre_assignment_is_nearest(spark):
    pts = _points(spark, SF)
    cs = centres_from_assignment(pts.withColumn("c", F.pmod("id", F.lit(3))), "c")
    out = assign_centres(pts, cs).collect()
    centres = {r.cluster: r.centre for r in cs.collect()}
    for r in out[:50]:
        d = {c: sum((float(x) - y) ** 2 for x, y in zip(r.features, v)) for c, v in centres.items()}
        assert r.prediction == min(d, key=lambda c: (d[c], c))
        assert r.dist2 == pytest.approx(d[r.prediction])
    sse_ssb = cohesion_separation(assign_centres(pts, cs), cs).first()
    assert sse_ssb.sse == pytest.approx(sum(r.dist2 for r in out))
    assert sse_ssb.ssb >= 0


def test_recomputed_sse_equals_model_cost(spark):
    pts = _vector_points(spark, SF)
    model, out = fit_predict(pts, "km", 3, max_iter=100, seed=21)
    from pyspark.ml.functions import vector_to_array
    arr = pts.select("id", vector_to_array("features").alias("features"))
    cs = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
                               "cluster int, centre array<double>")
    sse = cohesion_separation(assign_centres(arr, cs), cs).first().sse
    assert sse == pytest.approx(model.summary.trainingCost, rel=1e-6, abs=1e-6)


def _vector_points(spark, sf):
    """Reduced vectors from the events, as ML points."""
    vec = _stage2(spark, sf).vectors
    return checkpointed(vec.select("id", "label", to_vector("features").alias("features")))


def test_two_rounds_invariants_and_repeatable(spark):
    pts = _vector_points(spark, "/root/testdata/sf0.01")
    r1 = two_round_clustering(pts, "km", 4)
    r2 = two_round_clustering(pts, "km", 4)
    c1 = sorted(map(tuple, r1.checklist.collect()))
    assert c1 == sorted(map(tuple, r2.checklist.collect()))
    assert len(c1) == pts.count() and len({c[0] for c in c1}) == len(c1)
    sus1 = {r.id for r in r1.suspicious1.collect()}
    sus2 = {r.id for r in r1.suspicious2.collect()}
    assert sus2 <= sus1
    rep = r1.report.first()
    best1 = best_cluster(r1.summary1).first()
    assert rep.recall <= best1.recall + 1e-12
    assert rep.detected == sum(1 for c in c1 if c[1] == 1 and c[2] == 1)


def test_sweep_shape(spark):
    pts = _vector_points(spark, SF)
    rep = sweep(pts, "bkm", 2, 3, 2, parallelism=2).collect()
    assert {(r.k, r.round) for r in rep} == {(2, 1), (2, 2), (3, 1), (3, 2)}
    for k in (2, 3):
        for rnd in (1, 2):
            s1 = [r for r in rep if r.k == k and r.round == rnd and r.stage == 1]
            assert sum(r.recall for r in s1) == pytest.approx(1.0)


def test_model_argument_checks(spark):
    pts = _vector_points(spark, SF)
    with pytest.raises(ValueError):
        fit_predict(pts, "dbscan", 3)
    with pytest.raises(ValueError):
        sweep(pts, "km", 4, 3, 1)
    with pytest.raises(ValueError):
        sweep(pts.withColumn("label", F.lit(0)), "km", 2, 2, 1)


def test_sweep_fits_carry_the_callers_job_group(spark):
    pts = _vector_points(spark, SF)
    spark.sparkContext.setJobGroup("rolevec-sweep-test", "sweep")
    try:
        sweep(pts, "km", 2, 2, 2, parallelism=2)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("rolevec-sweep-test")
    assert len(jobs) > 10   # the k-means iterations of both rounds, not just the driver's own actions
