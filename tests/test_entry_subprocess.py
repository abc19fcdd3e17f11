"""The driver imports __spark_entry__ from elsewhere with its own default
session: UDF-backed queries must still find the package in Python workers."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry", {os.path.join(REPO, "__spark_entry__.py")!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").getOrCreate()
n = E.queries()["W7_clip_threshold"](spark, "/root/testdata/sf0.001").count()
m = E.queries()["K2_spectral_stats"](spark, "/root/testdata/sf0.001").count()
print("ROWS", n, m)
"""


def test_udf_queries_run_from_another_process():
    cwd = tempfile.mkdtemp(prefix="rf-driver-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
    n, m = map(int, out.stdout.split("ROWS")[1].split())
    assert n > 0 and m > 0
