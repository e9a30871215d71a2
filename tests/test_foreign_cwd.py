"""The driver imports __spark_entry__ from another working directory: Python
workers must not need the package on their path (helpers ship by value)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(REPO, "__spark_entry__.py")!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
q = m.queries()
print("ENTRY", len(m.entry(spark).collect()))
print("NFKC", q["t7_nfkc"](spark, "/root/testdata/sf0.001").count())
print("DEACC", q["t10_strip_accents"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_queries_run_from_foreign_cwd():
    cwd = tempfile.mkdtemp(prefix="tc-cwd-", dir="/tmp")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    assert "ENTRY 4" in out.stdout, out.stderr[-2000:]
    assert "NFKC" in out.stdout and "DEACC" in out.stdout, out.stderr[-2000:]
