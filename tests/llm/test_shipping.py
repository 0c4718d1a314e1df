import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

RUN = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in {names!r}:
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() >= 200
"""


def test_workers_need_no_package(tmp_path):
    """Python workers run in a folder of their own, without the repository on their path."""
    names = ["op3_crf_quality", "op6_license_templates", "op7_simhash_blocks", "op10_kneser_ney", "op11_block_whitening",
             "op12_curve_packing", "op13_period_runs"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", RUN.format(root=ROOT, names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
