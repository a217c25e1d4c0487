"""Whole pages in Python: the rows of many pages at once, as arrays, with no call per page.

Rows are dealt out by page and sorted once.  A worker takes some ten thousand rows at a time, cut where a page ends, so its
memory grows with the longest page and not with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows that are computed on at once, and pairs.
ROWS, PAIRS = 1 << 16, 1 << 20


class Pages(NamedTuple):
    """Rows of whole pages; those of page i are bounds[i] to bounds[i + 1].  known: whether the page of a row is not null."""

    table: pa.Table
    bounds: np.ndarray
    known: np.ndarray

    def place(self) -> np.ndarray:
        """Each row's place in its page, from 0."""
        return np.arange(len(self.table)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))

    def ids(self) -> np.ndarray:
        """The rows' line_id; where the table has none, their places."""
        return numbers(self.table, "line_id", np.int64) if "line_id" in self.table.column_names else self.place()


def dealt(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """rows for mapped(): those of equal keys in one partition, in order."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def mapped(rows: DataFrame, keys: list[str], run: Callable[[Pages], Iterator[pa.Table]], schema: str) -> DataFrame:
    """The tables that run makes of the pages (groups of equal keys) of rows, which come from dealt() with the same keys."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        count, enough = 0, ROWS
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count < enough:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(np.flatnonzero(begins(table, keys))[-1])
            if cut:
                yield table.slice(0, cut).combine_chunks()
            held, count = table.slice(cut).to_batches(), len(table) - cut
            enough = max(ROWS, 2 * count)  # a long page is looked through a few times only
        if count:
            yield pa.Table.from_batches(held).combine_chunks()

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole(batches):
            known = np.ones(len(table), bool)
            for k in keys:
                known &= table.column(k).is_valid().to_numpy()
            bounds = np.r_[np.flatnonzero(begins(table, keys)), len(table)]
            for out in run(Pages(table, bounds, known)):
                yield from out.combine_chunks().to_batches(max_chunksize=ROWS)

    return rows.mapInArrow(pages, schema)


def begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether the keys of a row are others than those of the row before."""
    out = np.zeros(len(table), bool)
    out[0] = True
    for k in keys:
        (column,) = table.column(k).chunks
        out[pc.run_end_encode(column).run_ends.to_numpy()[:-1]] = True
    return out


def numbers(table: pa.Table, name: str, kind: type = np.float64) -> np.ndarray:
    """A column as numbers; in doubles nulls are NaN."""
    column = table.column(name).cast(pa.from_numpy_dtype(kind))
    return column.to_numpy() if not column.null_count else column.to_numpy().astype(kind)


def pairs(bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows u < v of a page, in blocks of bounded size."""
    n = int(bounds[-1])
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n) - 1
    upto = np.r_[0, np.cumsum(left)]
    a = 0
    while a < n:
        b = max(int(np.searchsorted(upto, upto[a] + PAIRS, "right")) - 1, a + 1)
        u = np.repeat(np.arange(a, b), left[a:b])
        if len(u):
            yield u, u + 1 + np.arange(len(u)) - np.repeat(upto[a:b] - upto[a], left[a:b])
        a = b


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least row of each row's component; edges join the rows u and v."""
    top = np.arange(n)
    while True:
        a, b = top[u], top[v]
        apart = a != b
        if not apart.any():
            return top
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := top[top], top):
            top = up


def grouped(root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in the order of their groups, and where each group starts in it."""
    order = np.argsort(root, kind="stable")
    return order, np.flatnonzero(np.r_[True, np.diff(root[order]) != 0][: len(order)])
