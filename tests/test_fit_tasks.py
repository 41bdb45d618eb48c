"""Passes of a fit have tasks by the size of the points, and equal points leave an empty half."""

import importlib

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from rolevec.operators import cluster
from rolevec.operators.cluster import extent, fit_predict, in_order
from rolevec.operators.evaluate import sweep_checks

sweep_plan = importlib.import_module("rolevec.plans.sweep")
X = np.concatenate([np.random.default_rng(7).normal(c, 1.0, (30, 2)) for c in (0.0, 50.0)])


def points_of(spark, rows, parts=40):
    df = spark.createDataFrame(rows, "id long, label int, v array<double>")
    return df.select("id", "label", array_to_vector("v").alias("features")).repartition(parts)


@pytest.mark.parametrize("model", ["km", "bkm"])
def test_a_fit_has_few_tasks_for_few_points(spark, model):
    points = points_of(spark, [(k, k % 2, x.tolist()) for k, x in enumerate(X)])
    fitted, out = fit_predict(points, model, 2)
    assert fitted.summary.predictions.rdd.getNumPartitions() == 1  # the rows that were fitted
    assert fitted.summary.predictions.count() == out.count() == len(X)


@pytest.mark.parametrize("model", ["km", "bkm"])
def test_fits_of_a_sweep_share_few_tasks(spark, monkeypatch, model):
    points = points_of(spark, [(k, k % 2, x.tolist()) for k, x in enumerate(X)])
    seen = []
    real = sweep_plan.fit_predict
    monkeypatch.setattr(sweep_plan, "fit_predict", lambda df, m, k, **kw: (seen.append((k, df.rdd.getNumPartitions(), df.count())), real(df, m, k, **kw))[1])
    got = sweep_plan.sweep(points, model, 3, 3, 2).where("stage = 1").groupBy("round").sum("n").collect()
    assert [r[1] for r in got] == [len(X)] * 2
    assert [x for x in seen if x[0] == 3] == [(3, 1, len(X))] * 2


def test_more_points_have_more_tasks_and_all_rows_stay(spark, monkeypatch):
    monkeypatch.setattr(cluster, "VALUES_PER_TASK", 20)
    rows = [(k, 0, x.tolist()) for k, x in enumerate(X)] + [(None, 0, x.tolist()) for x in X] + [(3, 0, X[3].tolist())]
    points = points_of(spark, rows)
    same, tasks = extent(points)
    assert not same and tasks == -(-2 * len(rows) // 20)
    dealt = in_order(points, tasks)
    assert dealt.rdd.getNumPartitions() == tasks and dealt.count() == len(rows)
    # rows without an id don't meet in one task
    assert max(dealt.where("id is null").rdd.glom().map(len).collect()) < len(X) / 2
    assert extent(points.limit(0)) == (True, 1)


def test_a_chosen_cluster_of_one_point_has_an_empty_half(spark, tmp_out):
    rows = [(k, 0, x.tolist()) for k, x in enumerate(X)] + [(900, 1, [9000.0, 0.0])]
    points = points_of(spark, rows)
    plain = sweep_plan.sweep(points, "bkm", 3, 3, 1, ledger=f"{tmp_out}/plain")
    assert plain.where("stage = 2").count() == 1  # as before
    both = sweep_plan.sweep(points, "bkm", 3, 3, 1, both_halves=True)
    assert sorted(r.n for r in both.where("stage = 2").collect()) == [0, 1]
    checks = sweep_checks(both).first()
    assert (checks.halves, checks.n_gap, checks.bad_gap, checks.recall_gap, checks.n) == (2, 0, 0, 0.0, len(rows))
    with pytest.raises(ValueError, match="other points or settings"):
        sweep_plan.sweep(points, "bkm", 3, 3, 1, ledger=f"{tmp_out}/plain", both_halves=True)
