"""A folder that images arrive in, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from layertext.sources import files


def arriving(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """The stream of images that arrive in a folder, with the columns of files.listed()."""
    source = spark.readStream.schema(files.BINARY).format("binaryFile").option("recursiveFileLookup", "true")
    return files.named(source.option("maxFilesPerTrigger", files_a_batch).load(path))
