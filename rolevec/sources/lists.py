"""Side lists: known-case ids (one per line) and the motion dictionary (CSV,
first field = motion)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """``DF[id string]`` as written, distinct; blank lines are skipped.  Joins cast it to
    the type of the ids they meet."""
    lines = spark.read.text(path)
    return (lines.select(F.trim("value").alias("v")).where(F.col("v") != "")
            .select(F.col("v").alias("id")).distinct())


def write_id_list(ids: DataFrame, path: str, id_col: str = "id", mode: str = "errorifexists") -> None:
    ids.select(F.col(id_col).cast("string").alias("value")).write.mode(mode).text(path)


def read_motion_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``DF[position int, motion string]`` from the first field of every line.

    The file's order, repeats included: it is the column order of dense vectors.  Lines are
    numbered within their split of the files, and a split's first number is the count of lines in
    the splits before it, from one row per split."""
    split = ["_f", "_s"]
    lines = (spark.read.text(path)
             .select("value", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"),
                     F.monotonically_increasing_id().alias("_i"))
             .where(F.col("value") != ""))
    sizes = lines.groupBy(*split).agg(F.count(F.lit(1)).alias("n"))
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct(*split, "n"))).alias("all"))
    before = lambda j: F.aggregate(F.slice("all", 1, j), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    starts = listed.select(F.inline(F.transform("all", lambda x, j: F.struct(x["_f"].alias("_f"), x["_s"].alias("_s"), before(j).alias("_start")))))
    within = F.row_number().over(Window.partitionBy(*split).orderBy("_i"))
    return (lines.withColumn("_n", within).join(starts, split)
            .select((F.col("_start") + F.col("_n") - 1).cast("int").alias("position"), F.substring_index("value", ",", 1).alias("motion")))


def write_motion_dictionary(motions: DataFrame, path: str, motion_col: str = "motion",
                            name_col: str | None = None, mode: str = "errorifexists") -> None:
    name = F.col(name_col) if name_col else F.col(motion_col)
    (motions.select(F.concat_ws(",", F.col(motion_col), name).alias("value"))
     .write.mode(mode).text(path))
