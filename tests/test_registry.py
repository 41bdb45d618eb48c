"""Run registry: a repeated run replaces its own partition only, unfinished runs aren't seen."""

import pytest

from rolevec.plans import jobs
from rolevec.sinks import registry
from rolevec.sinks.registry import read_entries, read_runs, record_run


def _t(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def _rows(spark, base, table="t"):
    return sorted((r.run_id, r.v) for r in read_runs(spark, base, table).collect())


def test_repeated_runs_replace_their_own_rows(spark, tmp_out):
    assert record_run(spark, tmp_out, "0012", "j", {"k": 3, "none": None}, {"t": _t(spark, 1, 2), "u": _t(spark, 9)}) == {"t": 2, "u": 1}
    record_run(spark, tmp_out, "0102-0900", "j", {}, {"t": _t(spark, 5)})
    assert _rows(spark, tmp_out) == [("0012", 1), ("0012", 2), ("0102-0900", 5)]  # ids stay text
    record_run(spark, tmp_out, "0012", "j", {"k": 4}, {"t": _t(spark, 7)})
    assert _rows(spark, tmp_out) == [("0012", 7), ("0102-0900", 5)]
    entries = {(r.run_id, r.table_name): (r.params, r.n_rows) for r in read_entries(spark, tmp_out).collect()}
    assert entries == {("0012", "t"): ({"k": "4"}, 1), ("0102-0900", "t"): ({}, 1)}  # its table u is gone, too
    with pytest.raises(ValueError, match="no run holds"):
        read_runs(spark, tmp_out, "u")


def test_a_run_without_rows(spark, tmp_out):
    record_run(spark, tmp_out, "a", "j", {}, {"t": _t(spark)})
    assert _rows(spark, tmp_out) == []
    record_run(spark, tmp_out, "b", "j", {}, {"t": _t(spark, 1)})
    record_run(spark, tmp_out, "b", "j", {}, {"t": _t(spark)})
    record_run(spark, tmp_out, "c", "j", {}, {"t": _t(spark, 4)})
    assert _rows(spark, tmp_out) == [("c", 4)]
    assert {(r.run_id, r.n_rows) for r in read_entries(spark, tmp_out).collect()} == {("a", 0), ("b", 0), ("c", 1)}


def test_a_run_that_breaks_off_isnt_there(spark, tmp_out, monkeypatch):
    record_run(spark, tmp_out, "a", "j", {}, {"t": _t(spark, 1)})
    record_run(spark, tmp_out, "b", "j", {}, {"t": _t(spark, 2)})
    real = registry._write

    def broken(df, base, table, run_id):
        if table == registry.ENTRIES:
            raise RuntimeError("lost")
        return real(df, base, table, run_id)

    monkeypatch.setattr(registry, "_write", broken)
    for run_id in ("b", "c"):
        with pytest.raises(RuntimeError):
            record_run(spark, tmp_out, run_id, "j", {}, {"t": _t(spark, 3)})
    assert _rows(spark, tmp_out) == [("a", 1)]
    monkeypatch.undo()
    record_run(spark, tmp_out, "b", "j", {}, {"t": _t(spark, 4)})
    assert _rows(spark, tmp_out) == [("a", 1), ("b", 4)]


def test_refused_before_anything_is_written(spark, tmp_out):
    record_run(spark, tmp_out, "a", "j", {}, {"t": _t(spark, 1)})
    other = spark.createDataFrame([("x",)], "v string")
    for run_id, tables in (("b", {"t": other}), ("../b", {"t": _t(spark, 1)}), ("b", {"runs": _t(spark, 1)}), ("b", {}),
                           ("b", {"t": _t(spark, 1).withColumnRenamed("v", "Run_ID")})):
        with pytest.raises(ValueError):
            record_run(spark, tmp_out, run_id, "j", {}, tables)
    assert _rows(spark, tmp_out) == [("a", 1)]
    record_run(spark, tmp_out, "a", "j", {}, {"t": other})  # the only run may change its own columns
    assert [tuple(r) for r in read_runs(spark, tmp_out, "t").select("run_id", "v").collect()] == [("a", "x")]


def test_one_run_is_read_from_its_folder(spark, tmp_out):
    for run_id in ("a", "b"):
        record_run(spark, tmp_out, run_id, "j", {}, {"t": _t(spark, 1)})
    plan = read_runs(spark, tmp_out, "t").where("run_id = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and "(run_id" in plan.split("PartitionFilters")[1]


def test_jobs_enter_their_runs(spark, tmp_path, monkeypatch):
    lines = [f"{i}.0,{i % 3}.5,{10 * i + (i % 4 == 0)}" for i in range(1, 25)]
    (tmp_path / "vecs").write_text("\n".join(lines) + "\n")
    base = str(tmp_path / "registry")
    for stamp, model in (("0102-0900", "km"), ("0102-0901", "bkm"), ("0102-0900", "km")):
        monkeypatch.setattr(jobs, "run_stamp", lambda _spark, s=stamp: s)
        out = tmp_path / f"out-{stamp}-{len(list(tmp_path.iterdir()))}"
        jobs.secondary(spark, str(tmp_path / "vecs"), 2, 2, model, 1, str(out), registry=base)
    rows = read_runs(spark, base, "sweep").groupBy("run_id", "model").count().collect()
    assert {(r.run_id, r.model) for r in rows} == {("0102-0900", "km"), ("0102-0901", "bkm")}
    assert {r.params["model"] for r in read_entries(spark, base).collect()} == {"km", "bkm"}
