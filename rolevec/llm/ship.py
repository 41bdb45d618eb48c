"""Run Python functions of this package in Spark tasks wherever the driver found it.

The package's sources go to the executors once per Spark context, through Spark's
own file distribution, so tasks can import it even if only the driver has it on its path.
"""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import rolevec


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if getattr(sc, "_rolevec_shipped", False):
        return
    root = Path(rolevec.__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="rolevec-ship-")) / "rolevec_sources.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(archive))
    sc._rolevec_shipped = True


def give_back() -> None:
    """Return freed memory to the system: Spark keeps Python workers between tasks, and
    beside a full JVM heap what they hold on to counts."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not the C library that has it
        pass


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``mapInArrow`` with the package at hand."""
    ship(df.sparkSession)

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def map_groups(df: DataFrame, keys: list[str], run: Callable, schema) -> DataFrame:
    """``groupBy(keys).applyInPandas`` with the package at hand."""
    ship(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(run, schema)
