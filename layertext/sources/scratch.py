"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_scopes = threading.local()


def folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where it names none, a local one on a local master.

    On a cluster executors don't see each other's local folders, so there a missing name is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = tempfile.mkdtemp(prefix="layertext-")
    return _local[context.applicationId]


def _open_scopes() -> list[list[str]]:
    if not hasattr(_scopes, "paths"):
        _scopes.paths = []
    return _scopes.paths


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses; result() deletes what is there once its own table is written."""
    path = f"{folder(spark)}/layertext/{name}-{uuid.uuid4().hex}"
    for paths in _open_scopes()[-1:]:
        paths.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once: written to the shared folder and read back, so that a lost executor costs no more than a read.

    The table stays until result(), if it is open, or whoever owns the folder deletes it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    _write(df, path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's setting that deletes what a query has shuffled when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> None:
    """Write df; its shuffle files go at once, not only when the driver's garbage is collected, which may be never."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)


def result(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """Write what build() returns and delete the tables that were written on the way: only the result stays on disk.

    build() must not hand out tables in any other way, as they are gone afterwards.  The driver's garbage is collected, for
    until then the executors keep the shuffle files of what build() ran.
    """
    path = new_path(spark, name)
    _open_scopes().append([])
    try:
        df = build()
        _write(df, path)
    finally:
        for done in _open_scopes().pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(done)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    schema = df.schema
    del df
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)
