"""Level records in JSON lines: ``{"role": "17", "mark": "2", "seqs": [...]}``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolevec.functions.tokens import token_expand, token_motion

LEVEL_SCHEMA = T.StructType([
    T.StructField("role", T.StringType(), False),
    T.StructField("mark", T.StringType(), False),
    T.StructField("seqs", T.ArrayType(T.StringType()), False),
])


def read_level_json(spark: SparkSession, path: str) -> DataFrame:
    """Read level records with the declared schema.

    Broken lines fail the read (FAILFAST).  JSON readers relax ``nullable``,
    so a missing field would surface as NULL; every row is asserted instead.
    """
    raw = spark.read.schema(LEVEL_SCHEMA).option("mode", "FAILFAST").json(path)
    ok = F.col("role").isNotNull() & F.col("mark").isNotNull() & F.col("seqs").isNotNull()
    guard = F.assert_true(ok, F.lit("level record with a missing role, mark or seqs"))
    return raw.select(
        F.coalesce(guard.cast("string"), F.col("role")).alias("role"),
        F.col("mark"),
        F.col("seqs"),
    )


def write_level_json(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    records.select("role", "mark", "seqs").write.mode(mode).json(path)


#: Why a line is rejected, in the order of the checks (the first that holds is given).
REJECT_REASONS = ("not_a_record", "no_role", "no_mark", "no_seqs", "level_not_a_number", "null_token",
                  "token_without_motion")


def judge_level_json(spark: SparkSession, path: str, expand: bool = False) -> DataFrame:
    """``DF[file, line, role, mark, seqs, reason]``: every line of level JSON that isn't blank, with the
    first reason why a later step would fail on it (NULL: a sound record).

    ``not_a_record`` is text that doesn't parse as one object of the record's types.  A line that
    holds an array of records is rejected, too.  With ``expand`` a token must also hold the
    parameter that its motion asks for."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in LEVEL_SCHEMA] + [T.StructField("_broken", T.StringType())])
    parsed = F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    lines = (spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
             .where(F.trim("line") != ""))
    # written as a column of its own once: the reasons and the record read it
    rows = lines.select("file", "line", parsed.alias("_r")).select("file", "line", "_r.*")
    motion = (lambda t: token_expand(t)) if expand else token_motion
    whole = F.ltrim("line").startswith("{") & F.col("_broken").isNull()
    return rows.select("file", "line", "role", "mark", "seqs", _first_of({
        "not_a_record": ~whole,
        "no_role": F.col("role").isNull(),
        "no_mark": F.col("mark").isNull(),
        "no_seqs": F.col("seqs").isNull(),
        "level_not_a_number": F.col("mark").try_cast("int").isNull(),
        "null_token": F.exists("seqs", lambda t: t.isNull()),
        "token_without_motion": F.exists("seqs", lambda t: motion(t).isNull()),
    }).alias("reason"))


def _first_of(checks: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(checks[name], F.lit(name)) for name in REJECT_REASONS])


def read_level_json_quarantined(spark: SparkSession, path: str, rejected_path: str, expand: bool = False,
                                mode: str = "errorifexists") -> tuple[DataFrame, dict[str, int]]:
    """Sound level records, with all other lines set aside.

    One pass writes the rejected lines as a table ``(file, line, reason)`` to ``rejected_path`` and
    counts, on the same rows, the lines read and those of every reason: ``{"read": n, "kept": n,
    <reason>: n, ...}``.  The records themselves stay a lazy scan, ``DF[role, mark, seqs]``."""
    judged = judge_level_json(spark, path, expand)
    seen = Observation()
    counts = [F.count_if(F.col("reason") == r).alias(r) for r in REJECT_REASONS]
    (judged.select("file", "line", "reason")
     .observe(seen, F.count(F.lit(1)).alias("read"), F.count_if(F.col("reason").isNull()).alias("kept"), *counts)
     .where(F.col("reason").isNotNull()).write.mode(mode).parquet(rejected_path))
    # a later filter on the level may be evaluated before the one on the reason: marks that are no level read as NULL there
    mark = F.when(F.col("mark").try_cast("int").isNotNull(), F.col("mark")).alias("mark")
    return judged.where(F.col("reason").isNull()).select("role", mark, "seqs"), dict(seen.get)
