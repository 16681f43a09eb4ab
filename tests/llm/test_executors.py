"""Tasks run where the package is not installed."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {tmp!r}).getOrCreate()
import __spark_entry__ as entry
for name in {names!r}:
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_operators_without_the_package_on_executors(tmp_path):
    names = [n for n in ("op3_quality", "op4_decontamination", "op5_toxicity", "op8_language", "op10_backoff", "op11_resampling", "op13_jaccard") if n]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=str(ROOT), tmp=str(tmp_path / "shared"), names=names)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert {line.split()[0]: int(line.split()[1]) for line in done.stdout.splitlines() if line.startswith("op")} == dict.fromkeys(names, 200)
