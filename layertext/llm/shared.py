"""Tables in the cluster's shared folder, joins with small tables, and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layertext.sources.scratch import new_path, result, written

__all__ = ["components", "is_small", "join_small", "new_path", "result", "small_batches", "written"]

#: A table is broadcast only when a count has shown that it has at most so many rows.
BROADCAST_ROWS = 50_000
#: A key of more rows than this is dealt out where a join can't broadcast.
HOT_ROWS = 100_000

#: UTF-8 words are runs of bytes other than these; the pattern serves Spark and DuckDB alike.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts must fit a batch sent to Python; a setting that the user has made stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 32) -> DataFrame:
    """Join with a table that is usually small: broadcast when its counted rows allow it, else by the keys.

    Keys compare null-safe: a null key finds the row of the null key.  Where the table is not small, keys that are counted
    to be hot in `big` are dealt out by a salt, and only their rows of the table are repeated; all others join once.
    """
    small = small.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in small.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
    keys = [f"__{c}" for c in on]
    if is_small(small):
        return big.join(F.broadcast(small), same, how).drop(*keys)
    hot = written(big.groupBy(*on).count().where(F.col("count") > HOT_ROWS).select(*[F.col(c).alias(f"__h_{c}") for c in on], F.lit(True).alias("__hot")), "hot")
    if hot.isEmpty() or not is_small(hot):  # beyond that size no key holds a large share
        return big.join(small, same, how).drop(*keys)
    flag = lambda t, prefix: t.join(F.broadcast(hot), [F.col(f"{prefix}{c}").eqNullSafe(F.col(f"__h_{c}")) for c in on], "left").drop(*[f"__h_{c}" for c in on])
    repeated = flag(small, "__").withColumn("__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("__hot")
    dealt = flag(big, "").withColumn("__at", F.when(F.col("__hot"), F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")).otherwise(0)).drop("__hot")
    return dealt.join(repeated, [*same, F.col("__at") == F.col("__salt")], how).drop("__salt", "__at", *keys)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (u, v), root being the least node of its component.

    Alternating stars: the neighbours of a node are hung on its least neighbour until nothing changes.  Minima are
    aggregated before the shuffle and each round is written to the shared folder.  Self-loops are ignored; an empty
    input gives an empty result.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = written(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.withColumnRenamed("m", "v")).where("u != v").distinct(), name)
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
