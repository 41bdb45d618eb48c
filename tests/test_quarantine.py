"""Broken level records: set aside with a reason, counted, and never fatal to a job that asks for it."""

import json

import pytest

from rolevec.plans import jobs
from rolevec.sources.levels import REJECT_REASONS, judge_level_json, read_level_json, read_level_json_quarantined

SOUND = ['{"role":"7","mark":"2","seqs":["1@click_0@a"]}', '{"role":"8","mark":" 3 ","seqs":[]}',
         '{"extra":1,"seqs":["2@view_1@"],"mark":"4","role":"9"}', '{"role":10,"mark":5,"seqs":["3@x@"]}']
BROKEN = {
    '{"role":"7","mark":"2","seqs":["1@click_0@a"]': "not_a_record",
    "role,mark,seqs": "not_a_record",
    '[{"role":"7","mark":"2","seqs":[]},{"role":"8","mark":"2","seqs":[]}]': "not_a_record",
    '{"role":"7","mark":"2","seqs":"none"}': "not_a_record",
    '{"role":null,"mark":"x","seqs":[]}': "no_role",
    '{"role":"7","seqs":[]}': "no_mark",
    '{"role":"7","mark":"2"}': "no_seqs",
    '{"role":"7","mark":"2.5","seqs":[]}': "level_not_a_number",
    '{"role":"7","mark":"99999999999","seqs":[]}': "level_not_a_number",
    '{"role":"7","mark":"2","seqs":["1@click_0@a",null]}': "null_token",
    '{"role":"7","mark":"2","seqs":["1@click_0@a","lonely@"]}': "token_without_motion",
}


def _write(path, lines):
    path.mkdir()
    (path / "part-0.json").write_text("\n".join([*lines, "", "   "]) + "\n")
    return str(path)


def test_every_reason(spark, tmp_path):
    src = _write(tmp_path / "in", [*SOUND, *BROKEN])
    kept, counts = read_level_json_quarantined(spark, src, str(tmp_path / "bad"))
    assert sorted((r.role, r.mark.strip(), len(r.seqs)) for r in kept.collect()) == [("10", "5", 1), ("7", "2", 1), ("8", "3", 0), ("9", "4", 1)]
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert {r.line: r.reason for r in bad} == BROKEN and all(r.file.endswith("part-0.json") for r in bad)
    assert set(BROKEN.values()) == set(REJECT_REASONS)
    assert counts == {"read": len(SOUND) + len(BROKEN), "kept": len(SOUND),
                      **{r: list(BROKEN.values()).count(r) for r in REJECT_REASONS}}


def test_sound_lines_read_as_by_the_strict_reader(spark, tmp_path):
    src = _write(tmp_path / "in", SOUND)
    kept, counts = read_level_json_quarantined(spark, src, str(tmp_path / "bad"))
    assert sorted(kept.collect()) == sorted(read_level_json(spark, src).collect())
    assert counts["kept"] == counts["read"] == len(SOUND)
    assert spark.read.schema("line string").parquet(str(tmp_path / "bad")).count() == 0


def test_no_lines_at_all(spark, tmp_path):
    kept, counts = read_level_json_quarantined(spark, _write(tmp_path / "in", []), str(tmp_path / "bad"))
    assert kept.count() == 0 and set(counts.values()) == {0}


def test_expanded_tokens_need_their_parameter(spark, tmp_path):
    token = "1@5300040@a,,b"  # asks for a parameter that isn't there
    src = _write(tmp_path / "in", [json.dumps({"role": "7", "mark": "2", "seqs": [token]})])
    assert judge_level_json(spark, src).first().reason is None
    assert judge_level_json(spark, src, expand=True).first().reason == "token_without_motion"


def test_job_goes_on_without_the_broken_lines(spark, tmp_path):
    lines = [json.dumps({"role": r, "mark": m, "seqs": [f"1@m{r}@"]}) for r in ("7", "8") for m in ("2", "3")]
    (tmp_path / "ids").write_text("7\n")
    src = _write(tmp_path / "in", [*lines, *BROKEN])
    with pytest.raises(Exception):
        jobs.seq2vec(spark, src, str(tmp_path / "ids"), str(tmp_path / "strict"), 2, 3, 2)
    out = jobs.seq2vec(spark, src, str(tmp_path / "ids"), str(tmp_path / "out"), 2, 3, 2, rejected_path=str(tmp_path / "bad"))
    clean = jobs.seq2vec(spark, _write(tmp_path / "clean", lines), str(tmp_path / "ids"), str(tmp_path / "out2"), 2, 3, 2)
    assert sorted(spark.read.text(out).collect()) == sorted(spark.read.text(clean).collect())
    assert spark.read.parquet(str(tmp_path / "bad")).count() == len(BROKEN)
