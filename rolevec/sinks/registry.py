"""Registry of runs: result tables that hold the rows of many runs, one partition per run.

``record_run`` writes every table of a run into its own partition (dynamic overwrite: other
runs' partitions stay untouched) and enters the run last, so readers see finished runs only.  A
repeated run replaces what it wrote before, also where it writes no row or fewer tables.

Layout under ``base``: ``<table>/run_id=<id>/`` and ``runs/run_id=<id>/``, whose rows are
``(job, params, table_name, n_rows, table_schema)``, one per table of the run.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolevec.session import delete_path, path_exists

ENTRIES = "runs"
_ENTRY = T.StructType([
    T.StructField("job", T.StringType()),
    T.StructField("params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("table_name", T.StringType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("table_schema", T.StringType()),
])
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")  # safe as a folder, and as a partition value


def _partition(base: str, table: str, run_id: str) -> str:
    return f"{base.rstrip('/')}/{table}/run_id={run_id}"


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows with ``run_id`` as text, whatever it looks like; none if nothing was written."""
    full = T.StructType([*schema.fields, T.StructField("run_id", T.StringType())])
    return spark.read.schema(full).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], full)


def _write(df: DataFrame, base: str, table: str, run_id: str) -> int:
    """Replace the run's partition; the rows are counted by the write itself."""
    seen = Observation()
    (df.withColumn("run_id", F.lit(run_id)).observe(seen, F.count(F.lit(1)).alias("n"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
     .parquet(f"{base.rstrip('/')}/{table}"))
    n = int(seen.get["n"])
    if n == 0:  # a dynamic overwrite leaves a partition alone that gets no row
        delete_path(df.sparkSession, _partition(base, table, run_id))
    return n


def _shape(schema: T.StructType) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def record_run(spark: SparkSession, base: str, run_id: str, job: str, params: Mapping[str, object],
               tables: Mapping[str, DataFrame]) -> dict[str, int]:
    """Write a run's tables and enter it; returns the rows per table.

    Raises ``ValueError``, before anything is written, on names that don't fit a folder, on a table
    with a ``run_id`` column, and on one whose columns differ from those of the other runs."""
    if not tables:
        raise ValueError("a run holds at least one table")
    for name in (run_id, *tables):
        if not _NAME.fullmatch(name) or name == ENTRIES:
            raise ValueError(f"not a run id or table name: {name!r}")
    known = {(r["run_id"], r["table_name"]): r["table_schema"] for r in _listed(spark, base, list(tables), run_id)}
    for name, df in tables.items():
        if "run_id" in (c.lower() for c in df.columns):
            raise ValueError(f"table {name!r} has a column run_id of its own")
        for (other, table), text in known.items():
            if table == name and other != run_id and _shape(T.StructType.fromJson(json.loads(text))) != _shape(df.schema):
                raise ValueError(f"table {name!r} has other columns than in run {other!r}")
    delete_path(spark, _partition(base, ENTRIES, run_id))  # until it is finished the run isn't there
    for (run, table) in known:
        if run == run_id and table not in tables:
            delete_path(spark, _partition(base, table, run_id))
    counts = {name: _write(df, base, name, run_id) for name, df in tables.items()}
    given = {str(k): None if v is None else str(v) for k, v in params.items()}
    rows = [(job, given, name, n, tables[name].schema.json()) for name, n in counts.items()]
    _write(spark.createDataFrame(rows, _ENTRY).coalesce(1), base, ENTRIES, run_id)
    return counts


def _listed(spark: SparkSession, base: str, names: list[str], run_id: str) -> list:
    """One entry per table name among the other runs (their columns agree), and all of the run's own."""
    entries = _read(spark, f"{base.rstrip('/')}/{ENTRIES}", _ENTRY)
    own = entries.where(F.col("run_id") == run_id).select("run_id", "table_name", "table_schema")
    others = (entries.where((F.col("run_id") != run_id) & F.col("table_name").isin(names))
              .groupBy("table_name").agg(F.min_by(F.struct("run_id", "table_schema"), "run_id").alias("e"))
              .select("e.run_id", "table_name", "e.table_schema"))
    return own.unionByName(others).collect()


def read_entries(spark: SparkSession, base: str) -> DataFrame:
    """``DF[run_id, job, params, table_name, n_rows]`` of the finished runs."""
    return _read(spark, f"{base.rstrip('/')}/{ENTRIES}", _ENTRY).select("run_id", "job", "params", "table_name", "n_rows")


def read_runs(spark: SparkSession, base: str, table: str) -> DataFrame:
    """The table's rows of all finished runs, with ``run_id``; a filter on it reads those runs' folders only."""
    entries = _read(spark, f"{base.rstrip('/')}/{ENTRIES}", _ENTRY).where(F.col("table_name") == table)
    first = entries.orderBy("run_id").select("table_schema").first()
    if first is None:
        raise ValueError(f"no run holds a table {table!r}")
    rows = _read(spark, f"{base.rstrip('/')}/{table}", T.StructType.fromJson(json.loads(first["table_schema"])))
    return rows.join(entries.select("run_id"), "run_id", "left_semi")
