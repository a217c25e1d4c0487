"""Intermediate tables leave no shuffle files behind."""

import glob
import os

from pyspark.sql import functions as F

from layertext.sources import scratch


def shuffled(spark):
    """Bytes of shuffled rows that the session holds on disk."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(os.path.getsize(f) for d in dirs for f in glob.glob(os.path.join(d, "*", "shuffle_*.data")))


def test_what_a_table_shuffled_goes_with_its_writing(spark):
    before = shuffled(spark)
    rows = spark.range(0, 200_000, 1, 4).select((F.col("id") * 7919 % 200_000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
    held = [rows.repartition(3, "k")]
    held.append(scratch.written(held[0], "dealt"))
    assert held[1].count() == 200_000
    assert shuffled(spark) - before < 1_000_000
    assert spark.conf.get(scratch.CLEANUP) == "false"
