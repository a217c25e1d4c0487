"""Executors that have no copy of the package run the operators all the same."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
s.sparkContext.setLogLevel("OFF")
try:
    s.range(1).mapInArrow(lambda b: (__import__("layertext") and x for x in b), "id long").collect()
    print("THERE")
except Exception:
    print("MISSING")
for name, query in e.queries().items():
    if name.startswith("op") or name == "pipeline":
        print(name, query(s, "/root/testdata/sf0.001").count() >= 0)
"""


def test_workers_without_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    lines = [x for x in done.stdout.split("\n") if x]
    assert lines[0] == "MISSING" and len(lines) == 12, done.stdout + done.stderr[-2000:]
    assert all(x.endswith(" True") for x in lines[1:]), done.stdout
