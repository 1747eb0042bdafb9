"""The operators' Python tasks must run where the executors cannot import this package."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent
JOB = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("op1_tokeniser_fertility", "op3_bpe", "op12_phrases", "op13_prefix_trie"):
    print("done", entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0)
"""


def test_python_tasks_need_no_path(tmp_path):
    done = subprocess.run([sys.executable, "-c", JOB], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.stdout.count("done True") == 4, done.stderr[-2000:]
