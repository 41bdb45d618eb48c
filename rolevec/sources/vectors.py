"""Text vector formats written by the method, parsed back into long rows.

* unaligned: ``m,v,m,v,...,mix``  -- levels x top x (motion, value), then the
  composite label ``id * 10 + label``;
* reduced:   ``v,v,...,mix``.

Every line is parsed on its own (width from the line itself), with array
expressions, so parsing is a narrow map over the text partitions.  A line whose
width doesn't fit the given ``top`` raises: no cell is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolevec import defaults
from rolevec.functions.labels import decode_label
from rolevec.functions.tokens import split_keep_inner


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.col("value") != "")


def _levels_of(fields, top: int):
    """Number of levels of a line's fields; raises if the width doesn't fit ``top``."""
    cells = F.size(fields) - 1
    wrong = F.concat(F.lit("vector line of "), cells.cast("string"), F.lit(f" fields before the label doesn't fit top={top}"))
    return F.when(cells % (2 * top) != 0, F.raise_error(wrong).cast("int")).otherwise(F.call_function("div", cells, F.lit(2 * top)).cast("int"))


def _fields(line_col: str = "value"):
    return split_keep_inner(F.col(line_col), defaults.FIELD_SEP)


def parse_unaligned(lines: DataFrame, top: int = defaults.TOP_K, line_col: str = "value") -> DataFrame:
    """``DF[id, label, level_pos, slot, motion, value]``.

    Inside one level a repeated motion keeps its last (motion, value) pair, as
    a map built from the pairs would; the pad motion therefore appears once.
    """
    return explode_cells(parse_unaligned_rows(lines, top, line_col)) \
        .select("id", "label", "c.level_pos", "c.slot", "c.motion", "c.value")


def explode_cells(rows: DataFrame) -> DataFrame:
    """``(id, label, c)`` one row per cell.  ``explode_outer`` + a null filter:
    a plain ``explode`` makes the optimizer infer a ``size(cells) > 0`` filter
    below the projection, inlining the sorted cell array into the per-element
    lambdas (quadratic work per line)."""
    return (rows.select("id", "label", F.explode_outer("cells").alias("c"))
            .where(F.col("c").isNotNull()))


def parse_unaligned_rows(lines: DataFrame, top: int = defaults.TOP_K, line_col: str = "value") -> DataFrame:
    """One row per line: ``(id, label, n_levels, cells array<struct<level_pos, slot, motion, value>>)``."""
    f = F.col("_f")
    n_cells = (_levels_of(f, top) * F.lit(top)).cast("int")
    cells = F.transform(
        F.sequence(F.lit(0), n_cells - 1),
        lambda i: F.struct(
            F.call_function("div", i, F.lit(top)).cast("int").alias("level_pos"),
            F.element_at(f, (2 * i + 1).cast("int")).alias("motion"),
            (-(F.pmod(i, F.lit(top)) + 1)).cast("int").alias("neg_slot"),
            F.element_at(f, (2 * i + 2).cast("int")).cast("double").alias("value"),
        ),
    )
    parsed = (lines.select(_fields(line_col).alias("_f"))
              .where(F.size("_f") > 1)
              .select(F.element_at("_f", -1).alias("_mix"), _levels_of(f, top).alias("n_levels"),
                      F.sort_array(F.when(n_cells > 0, cells).otherwise(F.array())).alias("_s")))
    s = F.col("_s")
    last_wins = F.filter(
        s, lambda e, i: (i == 0)
        | (s[i - 1]["level_pos"] != e["level_pos"])
        | (s[i - 1]["motion"] != e["motion"]))
    idc, labc = decode_label("_mix")
    cells_out = F.transform(last_wins, lambda c: F.struct(
        c["level_pos"].alias("level_pos"), (-c["neg_slot"]).cast("int").alias("slot"),
        c["motion"].alias("motion"), c["value"].alias("value")))
    return parsed.select(idc.alias("id"), labc.alias("label"), "n_levels", cells_out.alias("cells"))


def parse_reduced(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """``DF[id, label, features array<double>]``."""
    parsed = lines.select(_fields(line_col).alias("_f")).where(F.size("_f") > 0)
    idc, labc = decode_label(F.element_at("_f", -1))  # from the text, before the numbers
    return parsed.select(idc.alias("id"), labc.alias("label"),
                         F.transform(F.slice("_f", 1, F.size("_f") - 1), lambda x: x.cast("double")).alias("features"))


def vector_shape(lines: DataFrame, top: int = defaults.TOP_K, line_col: str = "value") -> DataFrame:
    """One row ``(n_rows, width, n_levels)``; ragged input and a width that doesn't fit ``top`` raise."""
    w = F.size(_fields(line_col))
    n = F.max(_levels_of(_fields(line_col), top))
    agg = lines.agg(F.count(F.lit(1)).alias("n_rows"), F.min(w).alias("_lo"), F.max(w).alias("_hi"), n.alias("_n"))
    check = F.assert_true(F.col("_lo") == F.col("_hi"), F.lit("ragged vector rows"))
    return agg.select(
        "n_rows",
        F.coalesce(check.cast("int"), F.col("_hi")).alias("width"),
        F.col("_n").cast("int").alias("n_levels"),
    )
