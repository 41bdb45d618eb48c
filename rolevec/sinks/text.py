"""Text renderings of the vector tables and reports, and writers.

Numbers print as the JVM prints doubles (``100.0``, ``33.333333333333336``);
the last field of a vector line is the composite label ``id * 10 + label``.
Writers keep the partitions (``single_file=True`` gathers one file).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolevec import defaults
from rolevec.functions.labels import encode_label

SEP = defaults.FIELD_SEP


def _nums(arr: str):
    return F.transform(F.col(arr), lambda x: x.cast("double").cast("string"))


def format_unaligned(unaligned: DataFrame, id_col: str = "role") -> DataFrame:
    """``(id, line)``: ``m,v,m,v,...,mix`` from ``(role, label, motions, values)``."""
    pairs = F.flatten(F.transform(F.arrays_zip(F.col("motions").alias("m"), F.col("values").alias("v")),
                                  lambda z: F.array(z["m"], z["v"].cast("string"))))
    return unaligned.select(F.col(id_col).alias("id"),
                            F.concat_ws(SEP, pairs, encode_label(id_col, "label").cast("string")).alias("line"))


def format_dense(vectors: DataFrame, id_col: str = "id", features_col: str = "features") -> DataFrame:
    """``(id, line)``: ``v,v,...,mix`` (aligned and reduced vectors)."""
    return vectors.select(F.col(id_col).alias("id"),
                          F.concat_ws(SEP, _nums(features_col), encode_label(id_col, "label").cast("string"))
                          .alias("line"))


def format_assignments(assigned: DataFrame, id_col: str = "id", features_col: str = "features") -> DataFrame:
    """``(id, line)``: ``id,label,prediction,v,v,...``."""
    head = F.array(F.col(id_col).cast("string"), F.col("label").cast("string"), F.col("prediction").cast("string"))
    return assigned.select(F.col(id_col).alias("id"),
                           F.concat_ws(SEP, F.concat(head, _nums(features_col))).alias("line"))


def format_kept(kept: DataFrame, lo: int = 0) -> DataFrame:
    """``(level, line)``: ``(group,List((motion,cost),...))`` per level, the
    group being the 0-based level position ``level - lo`` (at most n pairs)."""
    per = kept.groupBy("level").agg(F.sort_array(F.collect_list(F.struct("rank", "motion", "cost"))).alias("_k"))
    pairs = F.transform("_k", lambda e: F.concat(F.lit("("), e["motion"], F.lit(","), e["cost"].cast("string"),
                                                 F.lit(")")))
    return per.select("level", F.concat(F.lit("("), (F.col("level") - F.lit(lo)).cast("string"), F.lit(",List("),
                                        F.concat_ws(",", pairs), F.lit("))")).alias("line"))


def _ratio(c: str):
    """A ratio in full (``null`` when undefined)."""
    return F.coalesce(F.col(c).cast("double").cast("string"), F.lit("null"))


def report_lines(summary1: DataFrame, summary2: DataFrame, report: DataFrame) -> DataFrame:
    """Evaluation report as ``(section, cluster, line)`` rows."""
    def rows(s: DataFrame, section: int, name: str) -> DataFrame:
        return s.select(F.lit(section).alias("section"), F.col("prediction").alias("cluster"),
                        F.concat(F.format_string(f"{name} cluster %d: n=%d bad=%d good=%d recall=",
                                                 "prediction", "n", "n_bad", "n_good"),
                                 _ratio("recall"), F.lit(" precision="), _ratio("precision")).alias("line"))
    tail = report.select(F.lit(3).alias("section"), F.lit(None).cast("int").alias("cluster"),
                         F.concat(F.format_string("chosen: cluster %d of round 1, cluster %d of round 2; "
                                                  "%d known cases, %d detected, recall ",
                                                  "cluster_1", "cluster_2", "n_bad", "detected"),
                                  _ratio("recall")).alias("line"))
    return rows(summary1, 1, "round 1").unionByName(rows(summary2, 2, "round 2")).unionByName(tail)


def sweep_lines(sweep: DataFrame) -> DataFrame:
    """Sweep report as ``(model, k, round, stage, cluster, line)`` rows."""
    return sweep.select("model", "k", "round", "stage", F.col("prediction").alias("cluster"),
                        F.concat(F.format_string("model=%s k=%d round=%d stage=%d cluster=%d n=%d bad=%d recall=",
                                                 "model", "k", "round", "stage", "prediction", "n", "n_bad"),
                                 _ratio("recall"), F.lit(" precision="), _ratio("precision")).alias("line"))


def with_run_id(df: DataFrame, fmt: str = defaults.RUN_STAMP_FORMAT) -> DataFrame:
    """Add the run stamp column ``run_id`` (``MMdd-HHmm`` by default)."""
    return df.withColumn("run_id", F.date_format(F.current_timestamp(), fmt))


def write_lines(lines: DataFrame, path: str, line_col: str = "line", single_file: bool = False,
                partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Write one text line per row; ``partition_by`` columns become folders."""
    cols = [F.col(line_col).alias("value")] + [F.col(c) for c in (partition_by or [])]
    out = lines.select(*cols)
    if single_file:
        out = out.repartition(1)  # unlike coalesce, leaves the stages before it parallel
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.text(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "errorifexists") -> None:
    """Parquet, the default sink for every intermediate table."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
