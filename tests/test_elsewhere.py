"""The entry works from any folder: nothing is read from beside the PySpark package, and
Python workers need no copy of this package on their path."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
spec = importlib.util.spec_from_file_location("entry_elsewhere", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
queries, sql = entry.queries(), entry.oracle_sql()
assert set(sql) <= set(queries)
for name in sys.argv[3:]:
    assert queries[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("ALL RAN")
"""


def test_runs_from_an_empty_folder(tmp_path):
    work = tmp_path / "work"
    work.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(ROOT), str(tmp_path / "shared"),
         "isolation_forest_score", "lof", "stream_repeated_failures", "one_class_svm"],
        cwd=work, env=env, capture_output=True, text=True, timeout=600)
    assert "ALL RAN" in run.stdout, run.stderr[-3000:]
