"""The four batch jobs chained on files derived from the smallest events table."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rolevec.plans import jobs
from rolevec.sources.events import level_records, positive_ids, read_events, token_rows
from rolevec.sources.levels import write_level_json
from rolevec.sources.lists import write_id_list

SF = "/root/testdata/sf0.001"


def test_jobs_end_to_end(spark, tmp_out):
    ev = read_events(spark, SF)
    write_level_json(level_records(token_rows(ev, 6, 2)), f"{tmp_out}/levels")
    write_id_list(positive_ids(ev), f"{tmp_out}/bad")
    unaligned = jobs.seq2vec(spark, f"{tmp_out}/levels", f"{tmp_out}/bad", f"{tmp_out}/s2v", 2, 6, 5,
                             single_file=True)
    lines = spark.read.text(unaligned).collect()
    assert len(lines) == 15 and all(len(r.value.split(",")) == 51 for r in lines)

    assert jobs.stored_top(spark, unaligned) == 5
    with pytest.raises(ValueError):
        jobs.dimred(spark, unaligned, f"{tmp_out}/no", 1, 3, top=10)
    base = jobs.dimred(spark, unaligned, f"{tmp_out}/dr", 1, 3)
    stamped = [p for p in Path(f"{tmp_out}/dr").iterdir()]
    assert len(stamped) == 1
    vec_lines = spark.read.text(str(stamped[0] / "redvecs")).collect()
    assert len(vec_lines) == 15 and all(len(r.value.split(",")) == 5 * 3 + 1 for r in vec_lines)
    assert base == str(stamped[0]) and spark.read.parquet(f"{base}/redevents").count() > 0

    out = jobs.pack(spark, unaligned, f"{tmp_out}/pk", "km", 3)
    check = spark.read.csv(f"{tmp_out}/pk/km/checklist").collect()
    assert len(check) == 15
    assert spark.read.text(f"{tmp_out}/pk/km/eva").count() >= 3
    assert out == f"{tmp_out}/pk/km"

    rep = jobs.secondary(spark, str(stamped[0] / "redvecs"), 2, 3, "km", 2, f"{tmp_out}/sec",
                         with_assignments=True)
    assert rep.select("k", "round").distinct().count() == 4
    res = [p for p in Path(f"{tmp_out}/sec").iterdir()][0] / "res"
    one = spark.read.text(str(res / "k=2" / "round=1" / "stage=1")).collect()
    assert len(one) == 15 and all(len(r.value.split(",")) == 3 + 15 for r in one)


def test_dictionary_variant(spark, tmp_out):
    ev = read_events(spark, SF)
    write_level_json(level_records(token_rows(ev, 6, 2)), f"{tmp_out}/levels")
    write_id_list(positive_ids(ev), f"{tmp_out}/bad")
    motions = ev.select(F.concat("event_type", F.lit("_"), F.pmod(F.get_json_object("props", "$.k").cast("long"),
                                                                   F.lit(2)).cast("string")).alias("m")).distinct()
    motions.select(F.concat_ws(",", "m", "m").alias("value")).write.text(f"{tmp_out}/dict")
    out = jobs.seq2vec(spark, f"{tmp_out}/levels", f"{tmp_out}/bad", f"{tmp_out}/dense", 2, 6, 5,
                       dictionary_path=f"{tmp_out}/dict")
    lines = spark.read.text(out).collect()
    assert len(lines) == 15 and all(len(r.value.split(",")) == 5 * 10 + 1 for r in lines)


def test_keep_below_variants(spark, tmp_out):
    ev = read_events(spark, SF)
    write_level_json(level_records(token_rows(ev, 6, 2)), f"{tmp_out}/levels")
    write_id_list(positive_ids(ev), f"{tmp_out}/bad")
    out = jobs.seq2vec(spark, f"{tmp_out}/levels", f"{tmp_out}/bad", f"{tmp_out}/kb", 3, 5, 5, keep_below=True)
    lines = spark.read.text(out).collect()
    assert lines and all(len(r.value.split(",")) == 4 * 5 * 2 + 1 for r in lines)   # levels 2..5
    motions = ev.select(F.concat("event_type", F.lit("_"), F.pmod(F.get_json_object("props", "$.k").cast("long"),
                                                                   F.lit(2)).cast("string")).alias("m")).distinct()
    motions.select(F.concat_ws(",", "m", "m").alias("value")).write.text(f"{tmp_out}/dict")
    out = jobs.seq2vec(spark, f"{tmp_out}/levels", f"{tmp_out}/bad", f"{tmp_out}/kbd", 3, 5, 5,
                       dictionary_path=f"{tmp_out}/dict", keep_below=True)
    dense = spark.read.text(out).collect()
    assert len(dense) == len(lines) and all(len(r.value.split(",")) == 4 * 10 + 1 for r in dense)


def test_jobs_leave_no_staged_tables(spark, tmp_out):
    from rolevec.session import checkpoint_dir

    ev = read_events(spark, SF)
    write_level_json(level_records(token_rows(ev, 6, 2)), f"{tmp_out}/levels")
    write_id_list(positive_ids(ev), f"{tmp_out}/bad")
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("rolevec-*"))
    unaligned = jobs.seq2vec(spark, f"{tmp_out}/levels", f"{tmp_out}/bad", f"{tmp_out}/s2v", 2, 6, 5)
    base = jobs.dimred(spark, unaligned, f"{tmp_out}/dr", 1, 3)
    jobs.pack(spark, unaligned, f"{tmp_out}/pk", "km", 3)
    jobs.secondary(spark, f"{base}/redvecs", 2, 2, "km", 1, f"{tmp_out}/sec")
    assert set(folder.glob("rolevec-*")) == before


def test_text_roles(spark, tmp_out):
    records = [("u17", "2", ["t@a@p", "t@a@p"]), ("u17", "3", ["t@b@p"]), ("x", "2", ["t@a@p"]), ("x", "3", []), ("y", "2", ["t@a@p"])]
    from rolevec.operators.counts import explode_sequences
    from rolevec.plans.vectorize import vectorize
    from rolevec.sources.levels import LEVEL_SCHEMA

    v = vectorize(explode_sequences(spark.createDataFrame(records, LEVEL_SCHEMA)), spark.createDataFrame([("u17",)], "id string"), 2, 3, 1)
    assert {r.role: (r.label, r.motions, r["values"]) for r in v.unaligned.collect()} == {"u17": (1, ["a", "b"], [100.0, 100.0]), "x": (0, ["a", "0"], [0.0, 0.0])}
    with open(f"{tmp_out}/l.json", "w") as f:
        for r, m, s in records:
            f.write('{"role": "%s", "mark": "%s", "seqs": %s}\n' % (r, m, str(s).replace("'", '"')))
    with open(f"{tmp_out}/ids", "w") as f:
        f.write("u17\n")
    with open(f"{tmp_out}/dict", "w") as f:
        f.write("b,x\na,y\n")
    # the composite label at the end of a line needs numbers; everything before it doesn't
    with pytest.raises(Exception):
        jobs.seq2vec(spark, f"{tmp_out}/l.json", f"{tmp_out}/ids", f"{tmp_out}/out", 2, 3, 1)
