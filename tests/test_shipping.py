"""Executors that have no copy of the package run the queries all the same."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
s.sparkContext.setLogLevel("OFF")
try:
    s.range(1).mapInArrow(lambda b: (__import__("layertext") and x for x in b), "id long").collect()
    print("THERE")
except Exception:
    print("MISSING")
for name in ("components", "mst_split", "quad_merge", "pixel_component_stats", "component_line_assignment", "jsx_block"):
    print(name, e.queries()[name](s, "/root/testdata/sf0.001").count() > 0)
import numpy as np
from layertext.plans import extraction
from layertext.sources import files, layered
page = np.full((300, 300, 3), 255, np.uint8)
page[100:120, 50:200] = 0
open("p.png", "wb").write(layered.png(page))
ports = extraction.Ports(read=lambda strip: ("w", 0.9, (0, 0, 0), (255, 255, 255)))
decoded = files.decoded(s, "p.png")
out = extraction.write(decoded, extraction.merged(extraction.lines(decoded, ports)), "out", ports).collect()
print("extraction", [r.error for r in out], len(out[0].outputs))
"""


def test_workers_without_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    lines = done.stdout.split("\n")
    assert lines[0] == "MISSING", done.stderr[-2000:]
    assert [x.rpartition(" ")[2] for x in lines[1:7]] == ["True"] * 6, done.stdout + done.stderr[-2000:]
    assert lines[7] == "extraction [None] 4", done.stdout + done.stderr[-2000:]
