"""Small public operators and renderings."""

import re

from pyspark.sql import functions as F

from rolevec.catalog.queries import _points, _stage1
from rolevec.operators.counts import role_count, role_count_value
from rolevec.operators.evaluate import cluster_summary
from rolevec.operators.scaling import scale_counts
from rolevec.sinks.text import format_kept, report_lines, sweep_lines, with_run_id
from rolevec.operators.evaluate import evaluation_report

SF = "/root/testdata/sf0.001"


def test_scale_counts_equals_plan(spark):
    v = _stage1(spark, SF)
    got = sorted(map(tuple, scale_counts(v.counts, v.ranges).collect()))
    assert got == sorted(map(tuple, v.scaled.collect()))


def test_role_count_scalar_matches(spark):
    v = _stage1(spark, SF)
    n = role_count(v.counts).first()["n_roles"]
    assert spark.range(1).select(role_count_value(v.counts).alias("n")).first()["n"] == n == v.roles.count()


def test_run_id_stamp(spark):
    stamp = with_run_id(spark.range(1)).first()["run_id"]
    assert re.fullmatch(r"\d{4}-\d{4}", stamp)


def test_kept_rendering(spark):
    kept = spark.createDataFrame([(3, 1, "a", 2.5), (3, 2, "b", 1.0), (4, 1, "c", 7.0)],
                                 "level int, rank int, motion string, cost double")
    got = {r.level: r.line for r in format_kept(kept, lo=2).collect()}
    assert got == {3: "(1,List((a,2.5),(b,1.0)))", 4: "(2,List((c,7.0)))"}


def test_report_and_sweep_lines(spark):
    pts = _points(spark, SF).withColumn("prediction", F.pmod("id", F.lit(3)).cast("int"))
    s1 = cluster_summary(pts, F.lit(47))
    s2 = cluster_summary(pts.where("prediction = 0").withColumn("prediction", F.pmod("id", F.lit(2)).cast("int")),
                         F.lit(47))
    lines = report_lines(s1, s2, evaluation_report(s1, s2, F.lit(47))).collect()
    assert sum(1 for r in lines if r.section == 1) == 3 and sum(1 for r in lines if r.section == 2) == 2
    assert [r for r in lines if r.section == 3][0].line.startswith("chosen: cluster")
    sw = s1.select(F.lit("km").alias("model"), F.lit(3).alias("k"), F.lit(1).alias("round"), F.lit(1).alias("stage"),
                   "*")
    assert sweep_lines(sw).count() == 3
