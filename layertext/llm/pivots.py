"""Exact top-k inner products by a pivot-distance index.

With M the largest norm, x -> (x, sqrt(M^2 - |x|^2)) and q -> (q M / |q|, 0) lie on one sphere, and the nearer they are the
larger is q.x.  Each vector is keyed by its nearest pivot and its distance from it; the annuli of the pivots' distances are
the cells of the index.  A query expands its cells in the order of their bounds, a few in the first round and FACTOR times
as many in each that follows; the triangle inequality bounds the scores of a cell, and a cell that can't hold a better
score than the k best so far is not searched, nor is any after it.

What is searched depends on the data: of clustered vectors a small share, of vectors without any structure in many
dimensions, whose distances are all about the same, every cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layertext.llm import shared

#: The most pivots, of which there are a quarter of the root of the vectors, and the annuli of each; vectors from which both
#: are chosen; cells that a query searches first.
PIVOTS, ANNULI, SAMPLE, FIRST = 256, 4, 4096, 8
#: How many times as many cells each round searches as the one before.
FACTOR = 8
#: Vectors and queries that meet in one task.
BLOCK = 4096


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): components as floor(256 * x); rows with a null id, vector or component or a non-finite one go."""
    x = F.transform(vectors["embedding"], lambda c: c.cast("double"))
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.where(finite).select("vec_id", F.transform("x", lambda c: F.floor(c * 256)).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers as doubles, padded with zeros to dim."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dim))
    flat = column.flatten().to_numpy()
    out[np.repeat(np.arange(len(column)), size), np.arange(len(flat)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)] = flat
    return out


def _distances(x: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    whole = np.c_[x, last]
    square = (whole**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * whole @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _last(x: np.ndarray, most: float) -> np.ndarray:
    return np.sqrt(np.maximum(most - (x**2).sum(axis=1), 0))


class Index:
    """Pivots and the edges of their annuli, from a sample of the vectors."""

    def __init__(self, sample: np.ndarray, most: float, pivots: int) -> None:
        self.most = most
        whole = np.c_[sample, _last(sample, most)]
        chosen, far = [0], np.full(len(whole), np.inf)
        while len(chosen) < min(pivots, len(whole)):
            far = np.minimum(far, ((whole - whole[chosen[-1]]) ** 2).sum(axis=1))
            chosen.append(int(far.argmax()))
        self.pivots = whole[chosen]
        d = _distances(sample, whole[:, -1], self.pivots)
        near = d.argmin(axis=1)
        self.edges = [np.quantile(d[near == p, p], np.arange(1, ANNULI) / ANNULI) if (near == p).any() else np.zeros(ANNULI - 1) for p in range(len(self.pivots))]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell and the distance from its pivot of each vector."""
        d = _distances(x, _last(x, self.most), self.pivots)
        p = d.argmin(axis=1)
        own = d[np.arange(len(d)), p]
        return p * ANNULI + np.array([np.searchsorted(self.edges[a], b, "right") for a, b in zip(p, own, strict=True)], int), own

    def turned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The norms of queries, and their distances from the pivots when they are stretched to the largest norm."""
        norm = np.sqrt((x**2).sum(axis=1))
        return norm, _distances(x * (np.sqrt(self.most) / np.maximum(norm, 1e-300))[:, None], np.zeros(len(x)), self.pivots)

    def bounds(self, x: np.ndarray, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """[query, cell]: the largest score that the triangle inequality allows in a cell whose distances are low..high."""
        norm, d = self.turned(x)
        d = d[:, number // ANNULI]
        apart = np.maximum(np.maximum(d - high, low - d) - 1e-6 * (1 + np.sqrt(self.most)), 0)
        # of two points of a sphere of radius R that are `apart` from one another the product is R^2 - apart^2 / 2
        return norm[:, None] * (np.sqrt(self.most) - apart**2 / (2 * np.sqrt(max(self.most, 1e-300)))) + 1e-6 * (1 + self.most)


def top_products(vectors: DataFrame, k: int = 5, every: int = 50, searched: list[dict[str, int]] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k largest inner products with the other rows, ties to smaller vec_id.

    vectors has vec_id and embedding; queries are the rows whose vec_id is divisible by `every`, candidates all rows but
    those of the query's own vec_id.  Components are taken as floor(256 * x).  Vectors that are null or hold null or
    non-finite components, and rows without an id, take no part.  A shorter vector counts as padded with zeros.  Repeated
    rows are candidates each; of repeated query ids the least vector asks.  Sums must stay below 2^53 to be exact.  An
    empty table gives an empty result.  Other columns are ignored.  `searched` gets the number of queries, cells and vectors,
    and for each round how many cells and vectors the queries searched in all.
    """
    spark = vectors.sparkSession
    rows = shared.written(quantised(vectors), "vectors")
    most, dim, there = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c)), F.max(F.size("v")), F.count("*")).first()
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    # pivots far apart, and annuli of equal counts, from a bounded sample; every vector is indexed
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    index = Index(_matrix(sample.column("v"), dim), most, max(2, min(PIVOTS, int(there**0.5 / 4))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = index.cells(_matrix(batch.column("v"), dim))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(cell.astype(np.int32)), pa.array(far)], names=["vec_id", "v", "cell", "far"])

    indexed = shared.written(rows.mapInArrow(place, "vec_id long, v array<long>, cell int, far double"), "index")
    # one row a cell: PIVOTS * ANNULI at most
    cells = sorted((r.cell, r.n, r.low, r.high) for r in indexed.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect())
    number, size, low, high = (np.array([c[i] for c in cells]) for i in range(4))
    parts = spark.createDataFrame([(c[0], c[1], -(-c[1] // BLOCK)) for c in cells], "cell int, n long, parts long")
    stored = indexed.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("vec_id", "v"), "parts").cast("int").alias("part"), "vec_id", "v")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, d = index.turned(_matrix(batch.column("v"), dim))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("v"), pa.array(d.argmin(axis=1).astype(np.int32))], names=["query_id", "v", "near"])

    # blocks of about BLOCK queries each, in the order of their nearest pivots: queries that ask for the same cells share one,
    # and a cell's vectors go to few blocks
    asked = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = shared.written(asked.mapInArrow(nearest, "query_id long, v array<long>, near int"), "asked")
    counts = sorted((r.near, r.n) for r in asked.groupBy("near").agg(F.count("*").alias("n")).collect())  # PIVOTS rows at most
    before = np.r_[0, np.cumsum([n for _, n in counts])].tolist()
    starts = spark.createDataFrame([(p, n, at) for (p, n), at in zip(counts, before, strict=False)], "near int, n long, start long")
    place = F.col("start") + F.pmod(F.xxhash64("query_id"), "n")
    asked = shared.written(asked.join(F.broadcast(starts), "near").select("query_id", "v", F.floor(place / BLOCK).alias("block")), "queries")
    if searched is not None:
        searched.append({"queries": asked.count(), "cells": len(cells), "vectors": there})

    def wanted(start: int, stop: int, queries: DataFrame) -> DataFrame:
        """(query_id, v, block, least, cell): the cells from `start` to `stop` in the order of each query's bounds that may hold
        a score of `least` or more."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    upto = index.bounds(_matrix(part.column("v"), dim), number, low, high)
                    order = np.argsort(-upto, axis=1, kind="stable")[:, start:stop]
                    q, c = np.nonzero(np.take_along_axis(upto, order, axis=1) >= part.column("least").to_numpy()[:, None])
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(q)).columns, pa.array(number[order[q, c]].astype(np.int32))], names=[*part.schema.names, "cell"])

        return queries.select("query_id", "v", "block", "least").mapInArrow(run, "query_id long, v array<long>, block long, least double, cell int")

    def search(key: tuple, queries: pa.Table, found: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(found):
            ids, own = found.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            there = _matrix(found.column("v"), dim)[order].T
            least = queries.column("least").to_numpy()
            asking = _matrix(queries.column("v"), dim)
            for i in range(0, len(own), 256):
                part = asking[i : i + 256] @ there
                part[(ids[None, :] == own[i : i + 256, None]) | (part < least[i : i + 256, None])] = -np.inf
                best = np.argsort(-part, axis=1, kind="stable")[:, :k]
                value = np.take_along_axis(part, best, axis=1)
                q, c = np.nonzero(value > -np.inf)
                out["query_id"].append(own[i + q])
                out["vec_id"].append(ids[best[q, c]])
                out["score"].append(value[q, c].astype(np.int64))
        return pa.table({n: pa.array(np.concatenate([*v, np.zeros(0, np.int64)])) for n, v in out.items()})

    def scored(pairs: DataFrame) -> DataFrame:
        dealt = pairs.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))).drop("n", "parts")
        # a cell's vectors go once to each block of queries that asks for the cell
        there = shared.join_small(stored, shared.written(pairs.select("cell", "block").distinct(), "wanted"), ["cell"])
        keys = ["cell", "part", "block"]
        return dealt.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    done = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    start, stop = 0, FIRST
    while start < len(cells):
        reached = done.groupBy(F.col("query_id").alias("q")).agg(F.when(F.count("*") >= k, F.min("score")).alias("reached"))
        queries = asked.join(reached, F.col("query_id") == F.col("q"), "left").withColumn("least", F.coalesce(F.col("reached").cast("double"), F.lit(float("-inf"))))
        pairs = shared.written(wanted(start, stop, queries), "pairs")
        if searched is not None:
            row = pairs.join(F.broadcast(parts), "cell").agg(F.count("*"), F.sum("n")).first()
            searched.append({"cells": row[0], "vectors": row[1] or 0})
        if pairs.isEmpty():  # the cells come in the order of their bounds: none that follows can do better
            break
        done = shared.written(best(done.drop("rank").unionByName(scored(pairs))), "best")
        start, stop = stop, stop + FACTOR * (stop - start)
    return done


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
