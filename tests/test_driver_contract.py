"""The driver imports ``__spark_entry__`` from elsewhere, with its own session."""

import subprocess
import sys
import tempfile
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry_mod", {str(REPO / "__spark_entry__.py")!r})
mod = importlib.util.module_from_spec(spec)
spec.loader.exec_module(mod)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
assert mod.entry(spark).count() > 0
n = mod.queries()["column_cost"](spark, "/root/testdata/sf0.001").count()   # runs a grouped pandas function
print("OK", n)
"""


def test_entry_and_pandas_function_from_another_folder():
    with tempfile.TemporaryDirectory() as cwd:
        out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, capture_output=True, text=True, timeout=600)
    assert "OK" in out.stdout, out.stderr[-3000:]
