"""Format -> write -> parse gives the same cells."""

from pyspark.sql import functions as F

from rolevec.catalog.queries import _stage1, _stage2
from rolevec.sinks.text import format_dense, format_unaligned, write_lines
from rolevec.sources.vectors import parse_reduced, parse_unaligned, read_lines, vector_shape

SF = "/root/testdata/sf0.001"


def test_unaligned_round_trip(spark, tmp_out):
    v = _stage1(spark, SF)
    path = f"{tmp_out}/u"
    write_lines(format_unaligned(v.unaligned), path, single_file=True)
    back = parse_unaligned(read_lines(spark, path), 5)
    cells = v.cells().select("id", "label", (F.col("level") - 2).alias("level_pos"), "motion", "value")
    assert sorted(map(tuple, back.drop("slot").collect())) == sorted(map(tuple, cells.collect()))
    shape = vector_shape(read_lines(spark, path), 5).first()
    assert shape["width"] == 5 * 5 * 2 + 1 and shape["n_levels"] == 5


def test_reduced_round_trip(spark, tmp_out):
    vec = _stage2(spark, SF).vectors
    path = f"{tmp_out}/r"
    write_lines(format_dense(vec), path)
    back = parse_reduced(read_lines(spark, path))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, vec.collect()))


def test_duplicate_motion_last_wins(spark):
    # top 2 -> two levels of two (motion, value) pairs
    lines = spark.createDataFrame([("a,1.0,a,2.0,0,0.0,0,0.0,171",)], "value string")
    rows = parse_unaligned(lines, 2).collect()
    got = sorted((r.level_pos, r.slot, r.motion, r.value) for r in rows)
    assert got == [(0, 2, "a", 2.0), (1, 2, "0", 0.0)]
    assert {(r.id, r.label) for r in rows} == {(17, 1)}


def test_ragged_input_raises(spark):
    import pytest

    lines = spark.createDataFrame([("a,1.0,171",), ("a,1.0,b,2.0,171",)], "value string")
    with pytest.raises(Exception):
        vector_shape(lines, 1).collect()


def test_a_width_that_doesnt_fit_raises(spark, tmp_out):
    """Written with top 7 and 10, read as 5 (or 3): nothing is cut off silently."""
    import pytest

    from rolevec.plans.jobs import _cells_from_text

    v = _stage1(spark, SF, k=7)
    path = f"{tmp_out}/seven"
    write_lines(format_unaligned(v.unaligned), path)
    for read in (parse_unaligned, vector_shape):
        with pytest.raises(Exception, match="doesn't fit top=3"):
            read(read_lines(spark, path), 3).collect()
    one = spark.createDataFrame([(",".join(["a,1.0"] * 14) + ",171",)], "value string")
    with pytest.raises(Exception, match="doesn't fit top=5"):
        parse_unaligned(one, 5).collect()
    # a multiple of the right width is caught by the value stored beside the vectors
    ten = f"{tmp_out}/ten/events"
    write_lines(format_unaligned(_stage1(spark, SF, k=10).unaligned), ten)
    write_lines(spark.createDataFrame([("10",)], "line string"), f"{ten}_top")
    with pytest.raises(ValueError, match="top=10"):
        _cells_from_text(spark, ten, 5)
    assert _cells_from_text(spark, ten, None)[2] == 5


def test_large_ids_survive_text(spark, tmp_out):
    rows = [(900719925474099370 // 10 * 10 + 7, 1), (90071992547409938, 1), (90071992547409937, 0)]
    vec = spark.createDataFrame([(i, y, [1.5, 0.0]) for i, y in rows], "id long, label int, features array<double>")
    write_lines(format_dense(vec), f"{tmp_out}/large")
    back = parse_reduced(read_lines(spark, f"{tmp_out}/large")).collect()
    assert sorted((r.id, r.label, r.features) for r in back) == sorted((i, y, [1.5, 0.0]) for i, y in rows)


def test_labels_other_than_0_and_1_raise(spark):
    import pytest

    for text in ("1.0,178", "1.0,17.5", "1.0,abc"):
        with pytest.raises(Exception):
            parse_reduced(spark.createDataFrame([(text,)], "value string")).collect()
    ok = parse_reduced(spark.createDataFrame([("1.0,171.0",)], "value string")).first()
    assert (ok.id, ok.label) == (17, 1)


def test_dictionary_order_is_the_files(spark, tmp_out):
    from rolevec.operators.topk import densify_dictionary
    from rolevec.sources.lists import read_motion_dictionary

    with open(f"{tmp_out}/d.csv", "w") as f:
        f.write("z,last\na,first\n\nm,x\nz,again\n")
    d = read_motion_dictionary(spark, f"{tmp_out}/d.csv")
    assert [(r.position, r.motion) for r in d.orderBy("position").collect()] == [(0, "z"), (1, "a"), (2, "m"), (3, "z")]
    rows = spark.createDataFrame([("r", 2, "z", 9.0, 1), ("r", 2, "a", 1.0, 1), ("r", 3, None, None, 1), ("q", 2, "other", 4.0, 0), ("q", 3, "m", 2.0, 0)],
                                 "role string, level int, motion string, value double, label int")
    got = {r.role: (r.label, r.features) for r in densify_dictionary(rows, d).collect()}
    assert got == {"r": (1, [9.0, 1.0, 0.0, 9.0, 0.0, 0.0, 0.0, 0.0]), "q": (0, [0.0] * 4 + [0.0, 0.0, 2.0, 0.0])}


def test_dictionary_of_several_splits(spark, tmp_path):
    """Files cut into splits of a few lines, read by many tasks: still the files' order."""
    from rolevec.sources.lists import read_motion_dictionary

    want = []
    (tmp_path / "d").mkdir()
    for part in range(3):
        names = [f"m{(part * 40 + i) * 7 % 50}" for i in range(40)]
        (tmp_path / "d" / f"part-{part}.csv").write_text("".join(f"{m},x{i}\n" + ("\n" if i % 9 == 0 else "") for i, m in enumerate(names)))
        want += names
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        d = read_motion_dictionary(spark, str(tmp_path / "d"))
        assert [tuple(r) for r in d.orderBy("position").collect()] == list(enumerate(want))
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "windowspecdefinition(_f" in plan  # numbered per split, not over the whole file
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.csv").write_text("")
    assert read_motion_dictionary(spark, str(tmp_path / "none")).count() == 0
