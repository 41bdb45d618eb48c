"""Hand-sized inputs with every edge, against the plain-Python restatement."""

import pytest
from pyspark.sql import functions as F

import reference_impl as ref
from rolevec.operators.counts import explode_sequences
from rolevec.plans.dimred import reduce_dimensions
from rolevec.plans.vectorize import vectorize
from rolevec.sources.levels import LEVEL_SCHEMA, read_level_json, write_level_json

LO, HI, K = 2, 4, 2


def t(m):
    return f"x@{m}@p0,,p1"


RECORDS = [
    # role 1: below-span and above-span levels, a repeated level-3 record, a tie
    ("1", "1", [t("a")]),
    ("1", "2", [t("a"), t("a"), t("b"), t("q")]),
    ("1", "3", [t("a"), t("c"), t("c"), t("d")]),
    ("1", "3", [t("a")]),
    ("1", "4", [t("b")]),
    ("1", "5", [t("z")]),
    # role 2: an empty level record (present, no motions), fewer than k motions
    ("2", "2", [t("a"), t("q")]),
    ("2", "3", [t("a"), t("a"), t("a")]),
    ("2", "4", []),
    # role 3: misses level 3 -> dropped by coverage
    ("3", "2", [t("a"), t("b"), t("q")]),
    ("3", "4", [t("a")]),
    # role 4: ties between b and e at level 4; q held by all with one count (max = min)
    ("4", "2", [t("a"), t("b"), t("b"), t("q")]),
    ("4", "3", [t("a")]),
    ("4", "4", [t("b"), t("b"), t("e"), t("e")]),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, LEVEL_SCHEMA)


@pytest.fixture(scope="module")
def positives(spark):
    return spark.createDataFrame([(2,)], "id long")


@pytest.fixture(scope="module")
def vec(records, positives):
    return vectorize(explode_sequences(records), positives, LO, HI, K)


def test_counts_ranges_scaling(vec):
    covered, ranges, scaled, _ = ref.vectorize(RECORDS, LO, HI, K)
    assert sorted(int(r["role"]) for r in vec.roles.collect()) == covered == [1, 2, 4]
    got_r = {(r.level, r.motion): (r.mx, r.mn) for r in vec.ranges.collect()}
    assert got_r == ranges
    assert ranges[(2, "a")][1] > 0          # every role holds it: real minimum
    assert ranges[(2, "q")] == (1, 1)       # max = min -> scaled 0
    got_s = {(int(r.role), r.level, r.motion): r.value for r in vec.scaled.collect()}
    assert got_s == scaled


def test_topk_and_padding(vec):
    _, _, _, padded = ref.vectorize(RECORDS, LO, HI, K)
    got = {(int(r.role), r.level, r.slot): (r.motion, r.value) for r in vec.padded.collect()}
    assert got == padded
    assert got[(2, 4, 1)] == ("0", 0.0)     # empty record: all pads
    assert got[(4, 4, 1)][0] == "b"         # tie: motion ascending
    top = vec.topk.collect()
    assert all(r.motion != "0" for r in top)


def test_labels_and_unaligned(vec):
    rows = {int(r.role): r for r in vec.unaligned.collect()}
    assert rows[2].label == 1 and rows[1].label == 0
    assert len(rows[1].motions) == (HI - LO + 1) * K


def test_n_roles_scalar(vec, spark):
    assert spark.range(1).select(vec.n_roles.alias("n")).first()["n"] == 3


def test_reduction_matches_reference(vec):
    covered, _, _, padded = ref.vectorize(RECORDS, LO, HI, K)
    cells, union, costs, kept, vectors = ref.reduce(padded, covered, LO, HI, 1, 2)
    red = reduce_dimensions(vec.cells(), LO, HI - LO + 1, column_k=1, n=2)
    assert {(r.level, r.motion) for r in red.union.collect()} == {(x, m) for x, ms in union.items() for m in ms}
    got_c = {(r.level, r.motion): (r.n_distinct, r.cost) for r in red.costs.collect()}
    assert got_c.keys() == costs.keys()
    for key, (nd, c) in costs.items():
        assert got_c[key][0] == nd
        assert got_c[key][1] == pytest.approx(c, abs=1e-9)
    assert {(r.level, r.rank): r.motion for r in red.kept.collect()} == kept
    got_v = {int(r.id): r.features for r in red.vectors.collect()}
    assert got_v == vectors


def test_keep_fewer_than_n(vec):
    red = reduce_dimensions(vec.cells(), LO, HI - LO + 1, column_k=5, n=5)
    assert red.kept.count() == 0
    v = red.vectors.collect()
    assert len(v) == 3 and all(x == 0.0 for r in v for x in r.features)


def test_keep_below_pads_all_roles(records, positives):
    v = vectorize(explode_sequences(records), positives, LO, HI, K, keep_below=True)
    levels = {(int(r.role), r.level) for r in v.padded.collect()}
    assert (2, 1) in levels and (1, 1) in levels   # level 1 kept, padded for role 2


def test_json_round_trip(spark, records, tmp_out):
    path = f"{tmp_out}/levels"
    write_level_json(records, path)
    back = read_level_json(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted((r, m, s) for r, m, s in RECORDS)


def test_json_missing_field_fails(spark, tmp_out):
    path = f"{tmp_out}/bad"
    spark.createDataFrame([('{"role": "1", "seqs": []}',)], "value string").write.text(path)
    with pytest.raises(Exception):
        read_level_json(spark, path).collect()


def test_argument_checks(records, positives):
    with pytest.raises(ValueError):
        vectorize(explode_sequences(records), positives, LO, HI, 0)
    with pytest.raises(ValueError):
        vectorize(explode_sequences(records), positives, 5, 4, 2)


def test_materialized_tables_cut_the_lineage(spark, records, positives):
    v = vectorize(explode_sequences(records), positives, LO, HI, K, materialize=True)
    ckpt = spark.sparkContext.getCheckpointDir()
    for df in (v.ranked, v.cells()):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "LocalRelation" not in plan and "Relation" in plan
        assert all(str(ckpt).split(":")[-1] in f for f in df.inputFiles())


def test_coverage_of_many_levels(spark):
    """More levels than a word of presence bits holds; levels outside the span don't count."""
    from rolevec.operators.counts import WORD_LEVELS, covered_roles

    hi = 2 * WORD_LEVELS + 7
    rows = [("whole", x) for x in range(-3, hi + 3)] + [("whole", 5)] * 3 + [("gap", x) for x in range(-3, hi + 3) if x != WORD_LEVELS + 1] + [("end", x) for x in range(1, hi)]
    df = spark.createDataFrame(rows, "role string, level int")
    assert [r.role for r in covered_roles(df, 1, hi).collect()] == ["whole"]
    assert sorted(r.role for r in covered_roles(df, 1, 1).collect()) == ["end", "gap", "whole"]
