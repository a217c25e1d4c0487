"""Image files as tables, and one output folder for each image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layertext.functions import text

#: What Spark's binaryFile source returns.
BINARY = "path string, modificationTime timestamp, length long, content binary"


def named(files: DataFrame, kept: Column | None = None) -> DataFrame:
    """The images among files (path), with folder, base (name without extension) and order (natural within the folder).

    kept: the files to keep instead of those with an image's extension.
    """
    name = F.regexp_extract("path", "([^/]+)$", 1)
    rows = files.where(text.is_image(F.col("path")) if kept is None else kept).withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]+$", 1))
    return rows.withColumn("base", F.regexp_replace(name, "\\.[^.]+$", "")).withColumn("order", text.natural_key(name))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The images of a folder and the folders in it, or a single file, whatever its name; contents are read only where a
    column asks for them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return named(files, F.lit(True) if is_file(spark, path) else None)


def is_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(store.exists(at) and store.getFileStatus(at).isFile())


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, n_channels, data and error: null, or why the image stands aside.  No file stops the others."""
    rows = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    if not is_file(spark, path):
        rows = rows.where(text.is_image(F.col("origin")))
    error = F.when(F.coalesce("width", F.lit(-1)) < 0, F.lit("not decodable"))
    return rows.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("n_channels"), "data", error.alias("error"))


def checked(files: DataFrame, digests: DataFrame) -> DataFrame:
    """files (path, content) with digest, the SHA-256 of the content, and intact: whether digests (path, expected) has the same
    for it; null where it has none.  Digests are compared without regard to case."""
    rows = files.withColumn("digest", F.sha2("content", 256)).join(digests, "path", "left")
    return rows.withColumn("intact", F.col("digest") == F.lower("expected")).drop("expected")


def collisions(images: DataFrame) -> DataFrame:
    """images (path, base), with the number of images that would write to the same output."""
    return images.withColumn("same_output", F.count("*").over(Window.partitionBy("base")))


def write_documents(documents: DataFrame, path: str, mode: str = "error") -> None:
    """Write documents (base, document) as text, each in a folder base=... of its own, through Spark's own writer.

    It reaches every store that Spark does, and a lost task is written again.  A null document writes nothing.  Of
    documents with the same base all are kept, as lines of the same folder.
    """
    documents.where("document is not null").select("base", "document").write.mode(mode).partitionBy("base").text(path)
