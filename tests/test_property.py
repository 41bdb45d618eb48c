"""Random level records: Spark plans == plain-Python restatement."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import reference_impl as ref
from rolevec.operators.align import align_union, motion_union
from rolevec.operators.counts import explode_sequences
from rolevec.plans.dimred import reduce_dimensions
from rolevec.plans.vectorize import vectorize
from rolevec.sources.levels import LEVEL_SCHEMA

LO, HI = 2, 4

record = st.tuples(
    st.integers(1, 6).map(str),                                  # role
    st.integers(1, 5).map(str),                                  # level (1 and 5 lie outside the span)
    st.lists(st.sampled_from("abcde0"), max_size=8).map(lambda ms: [f"t@{m}@p" for m in ms]),
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(record, min_size=1, max_size=30), st.integers(1, 3), st.integers(1, 3), st.integers(1, 3),
       st.booleans())
def test_random_records(spark, records, k, column_k, n, materialize):
    covered, ranges, scaled, padded = ref.vectorize(records, LO, HI, k)
    df = spark.createDataFrame(records, LEVEL_SCHEMA)
    pos = spark.createDataFrame([(2,), (4,)], "id long")
    v = vectorize(explode_sequences(df), pos, LO, HI, k, materialize=materialize)
    assert sorted(int(r.role) for r in v.roles.collect()) == covered
    assert {(r.level, r.motion): (r.mx, r.mn) for r in v.ranges.collect()} == ranges
    assert {(int(r.role), r.level, r.motion): r.value for r in v.scaled.collect()} == scaled
    assert {(int(r.role), r.level, r.slot): (r.motion, r.value) for r in v.padded.collect()} == padded
    if not covered:
        return
    cells, union, costs, kept, vectors = ref.reduce(padded, covered, LO, HI, column_k, n)
    aligned = align_union(v.cells(), motion_union(v.cells())).collect()
    assert {(int(r.id), r.level, r.motion): r.value for r in aligned} == {
        (r, x, m): cells.get((r, x, m), 0.0) for r in covered for x in range(LO, HI + 1) for m in union[x]}
    red = reduce_dimensions(v.cells(), LO, HI - LO + 1, column_k, n, materialize=materialize)
    got_costs = {(r.level, r.motion): (r.n_distinct, r.cost) for r in red.costs.collect()}
    assert got_costs.keys() == costs.keys()
    for key, (nd, c) in costs.items():
        assert got_costs[key][0] == nd and got_costs[key][1] == pytest.approx(c, abs=1e-9)
    assert {(r.level, r.rank): r.motion for r in red.kept.collect()} == kept
    got_vec = {int(r.id): r.features for r in red.vectors.collect()}
    assert got_vec == {r: vectors[r] for r in covered}
    labels = {int(r.id): r.label for r in red.vectors.collect()}
    assert labels == {r: int(r in (2, 4)) for r in covered}


line_cells = st.lists(st.tuples(st.sampled_from(["a", "b", "c", "0"]), st.integers(0, 4).map(lambda x: x * 12.5)),
                      min_size=1, max_size=12)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(line_cells, min_size=1, max_size=5), st.integers(1, 4))
def test_parse_unaligned_last_pair_wins(spark, lines, top):
    from rolevec.sources.vectors import parse_unaligned

    texts, want = [], set()
    for i, cells in enumerate(lines):
        cells = cells * top  # whole levels only
        fields = [x for m, v in cells for x in (m, repr(float(v)))]
        texts.append((",".join(fields + [str((i + 1) * 10 + i % 2)]),))
        n_levels = len(cells) // top
        for g in range(n_levels):
            last = {}
            for slot, (m, v) in enumerate(cells[g * top:(g + 1) * top], 1):
                last[m] = (slot, float(v))
            want |= {(i + 1, i % 2, g, slot, m, v) for m, (slot, v) in last.items()}
    df = spark.createDataFrame(texts, "value string")
    got = {(r.id, r.label, r.level_pos, r.slot, r.motion, r.value) for r in parse_unaligned(df, top).collect()}
    assert got == want
