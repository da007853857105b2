"""A plain session started from another folder: workers don't have the repository on
their path and get the package from the session."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys, tempfile
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="affinity-test-ckpt-")).getOrCreate())
import __spark_entry__ as entry
from affinity.llm import QUERIES
for name in QUERIES:
    rows = entry.queries()[name](spark, entry.SMOKE_DIR).collect()
    assert rows, name
    print(name, len(rows))
"""


def test_every_operator_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, str(Path(__file__).parents[2])], cwd=tmp_path, env=env, text=True,
                          capture_output=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert done.stdout.count("op") >= 13
