"""Session helpers: shared checkpoint folder and fresh scratch paths.

On a cluster the shared folder is whatever ``spark.checkpoint.dir`` names; it is
read from the session.  Only when it is unset (local runs, tests) a private
folder is created and registered.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Per thread: paths of the tables staged inside the current ``staging`` block.
_scope = threading.local()

#: Bucketed staged tables: path -> name in the session's catalog.
_tables: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's reliable checkpoint folder, registering it if needed."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset static conf
            configured = None
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(e.g. on HDFS or an object store); staged tables and checkpoints go there")
        # Unset in a local session (tests, bench): a private folder will do.
        configured = tempfile.mkdtemp(prefix="rolevec-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused sub-folder of the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/rolevec-{name}-{uuid.uuid4().hex}"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "rolevec") -> SparkSession:
    """Session for tests and the bench: AQE on, UI off."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def stage_table(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """Write ``df`` once as a parquet table in a fresh folder of the shared
    checkpoint folder and read it back.

    Used for intermediates with several consumers: they are computed once
    instead of once per consumer, the lineage is cut (a lost executor costs a
    re-read, not a re-scan of the input), and later scans get column pruning
    and real size statistics for the join planner.  Inside a ``staging`` block the
    table lives as long as the block, or with ``outlive`` as long as the block around it
    (for good, if there is none): a block's result."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("errorifexists").parquet(path)
    _note(path, outlive)
    return spark.read.parquet(path)


def _note(path: str, outlive: bool) -> None:
    if (paths := getattr(_scope, "outer" if outlive else "paths", None)) is not None:
        paths.append(path)


def stage_bucketed(df: DataFrame, name: str, column: str, sort: tuple[str, ...] = (),
                   metrics: tuple[Column, ...] = (), drop: tuple[str, ...] = ()) -> tuple[DataFrame, dict]:
    """:func:`stage_table` as a table bucketed by ``column`` (one bucket per shuffle partition, one file
    per bucket), and ``metrics`` (aliased aggregates) as the write saw them.

    Later groupings, windows and joins by ``column`` read the buckets as they are, without an
    exchange.  Rows that are already dealt by ``column`` are written without one, too.  The files
    lie in the shared checkpoint folder; the catalog holds the name only."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"`{spark.catalog.currentDatabase()}`.`{path.rsplit('/', 1)[1].replace('-', '_')}`"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, column)
    seen = Observation() if metrics else None
    if seen is not None:
        dealt = dealt.observe(seen, *metrics)
    writer = dealt.drop(*drop).write.format("parquet").mode("errorifexists").option("path", path).bucketBy(n, column)
    (writer.sortBy(*sort) if sort else writer).saveAsTable(table)
    _tables[path] = table
    _note(path, outlive=False)
    return spark.table(table), dict(seen.get) if seen is not None else {}


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable, eager ``checkpoint()`` into the shared checkpoint folder
    (registered first if the session has none yet)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store its path names."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there a folder or file, in whatever store the path names?"""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


@contextmanager
def staging(spark: SparkSession) -> Iterator[list[str]]:
    """Tables staged inside the block are deleted when it ends: a job wraps its work in
    it, so a run leaves nothing behind but its outputs.  Yields the list of their paths;
    a caller that keeps some may clear it and delete them later."""
    outer, around = getattr(_scope, "paths", None), getattr(_scope, "outer", None)
    _scope.paths, _scope.outer = (paths := []), outer
    try:
        yield paths
    finally:
        _scope.paths, _scope.outer = outer, around
        for path in paths:
            if (table := _tables.pop(path, None)) is not None:
                spark.sql(f"DROP TABLE IF EXISTS {table}")
            delete_path(spark, path)
