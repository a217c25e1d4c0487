"""Dictionaries of a reader: one entry a line, numbered from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, path: str) -> DataFrame:
    """(tok, char) of the text file's lines.  Of each line its last character, the line's end, goes; so does the last character
    of a last line that has no end."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n?", "\n").alias("v"))
    lines = F.split("v", "\n")
    count = F.size(lines)
    rows = whole.select(F.posexplode(lines).alias("tok", "char"), count.alias("n")).where("tok < n - 1 or char != ''")
    return rows.select("tok", F.when(F.col("tok") < F.col("n") - 1, F.col("char")).otherwise(F.expr("left(char, length(char) - 1)")).alias("char"))
