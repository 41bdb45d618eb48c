"""Staged tables bucketed by role: what they hold, and that plans on them don't shuffle by role."""

import re

import pytest
from pyspark.sql import functions as F

from rolevec.operators.counts import coverage_filter, covered_counts
from rolevec.plans.dimred import reduce_dimensions
from rolevec.plans.vectorize import vectorize
from rolevec.session import stage_bucketed, staging

COUNTS = [("a", 1, "x", 2), ("a", 2, "y", 1), ("a", 2, "z", 5), ("b", 1, "x", 1), ("c", 1, None, 0), ("c", 2, "y", 4), ("c", 3, "y", 4), (None, 1, "x", 1), (None, 2, "x", 1)]


def exchanges(df) -> list[str]:
    """Partitioning of every shuffle of the plan."""
    return re.findall(r"(?<!Broadcast)Exchange (\w+\([^)]*\)|SinglePartition)", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def events(spark):
    rows = [(f"r{i % 23}", level, f"m{(i * level) % 7}") for i in range(400) for level in (1, 2, 3) if i % 23 != 5 or level != 2]
    rows += [("r1", 1, "m0")] * 500
    return spark.createDataFrame(rows, "role string, level int, motion string"), spark.createDataFrame([("r1",), ("r1",), ("r5",), ("none",), (None,)], "id string")


def test_covered_counts_equal_the_joined_form(spark):
    counts = spark.createDataFrame(COUNTS, "role string, level int, motion string, cnt long")
    known = spark.createDataFrame([("c",), ("c",), ("b",), ("q",), (None,)], "id string")
    got = covered_counts(counts, known, 1, 2).collect()
    want = coverage_filter(counts, 1, 2).collect()
    assert sorted(map(str, [(r.role, r.level, r.motion, r.cnt) for r in got])) == sorted(map(str, [(r.role, r.level, r.motion, r.cnt) for r in want]))
    assert {(r.role, r.label) for r in got} == {("a", 0), ("c", 1)}
    assert sorted(r.role for r in got if r.first) == ["a", "c"]
    assert covered_counts(counts.limit(0), known, 1, 2).isEmpty()


def test_plans_on_the_buckets_do_not_shuffle_by_role(spark, events):
    rows, known = events
    with staging(spark):
        v = vectorize(rows, known, 1, 3, 2)
        assert exchanges(v.unaligned) == [] and exchanges(v.topk) == []
        red = reduce_dimensions(v.cells(), 1, 3, 2, 2, roles=v.roles.select(F.col("role").alias("id"), "label"))
        assert not [e for e in exchanges(red.vectors) if "id#" in e or "role#" in e]
        lazy = vectorize(rows, known, 1, 3, 2, materialize=False)
        assert sorted(v.unaligned.collect()) == sorted(lazy.unaligned.collect())
        plain = reduce_dimensions(lazy.cells(), 1, 3, 2, 2, roles=lazy.roles.select(F.col("role").alias("id"), "label"), materialize=False)
        assert sorted(red.vectors.collect()) == sorted(plain.vectors.collect())
        assert {r.role: r.label for r in v.roles.collect()} == {f"r{i}": int(i == 1) for i in range(23) if i != 5}


def test_bucketed_tables_go_with_their_block(spark):
    rows = spark.range(50).withColumn("drop_me", F.lit(1))
    with staging(spark) as paths:
        table, seen = stage_bucketed(rows, "numbers", "id", ("id",), (F.sum("drop_me").alias("n"),), drop=("drop_me",))
        assert table.columns == ["id"] and table.count() == seen["n"] == 50
        empty, none = stage_bucketed(rows.limit(0), "nothing", "id", (), (F.count(F.lit(1)).alias("n"),))
        assert empty.count() == none["n"] == 0
        assert len(paths) == 2 and [t for t in spark.catalog.listTables() if t.name.startswith("rolevec_numbers")]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(("rolevec_numbers", "rolevec_nothing"))]
