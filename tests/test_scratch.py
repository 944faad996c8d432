import os
import subprocess
import sys
from pathlib import Path

PROGRAM = """
from pyspark.sql import SparkSession
from wiresift.scratch import SHARED, scratch_dir
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert not spark.conf.get(SHARED, None)
first, second = scratch_dir(spark, "a"), scratch_dir(spark, "b")
spark.range(3).write.parquet(first)
assert spark.read.parquet(first).count() == 3 and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0] and first != second
print("fine")
"""


def test_a_plain_local_session_gets_a_folder(tmp_path):
    """No folder is named anywhere: the container's own defaults are left out."""
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[1]), "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", PROGRAM], env=env, capture_output=True, text=True, timeout=170)
    assert "fine" in done.stdout, done.stderr[-2000:]
