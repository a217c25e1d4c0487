"""Joins of the lines of a page by nearness."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layertext.functions import geometry
from layertext.operators import paged

_KEPT = ("x", "y", "w", "h", "fs", "ar", "direction", "line_id")


@dataclass(frozen=True)
class Nearness:
    """Tolerances in font sizes, but for `centre`, which counts pixels as well."""

    discard: float = 2
    gap: float = 0.6
    edge: float = 1.5
    font: float = 1.5
    aspect: float = 2
    ratio: float = 1.9


MERGE = Nearness(gap=1, edge=3, font=2, aspect=1.3)
READ = Nearness(aspect=1)


def paired(lines: DataFrame, kept: tuple[str, ...] = _KEPT) -> DataFrame:
    """page_id, a_* and b_* of all pairs of lines of a page, a's line_id below b's; lines of a null page have none.

    An image's lines are some thousands at most; grid_edges() is for pages of more.
    """
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    schema = ", ".join([f"page_id {kinds['page_id']}", *[f"{p}_{c} {kinds[c]}" for p in "ab" for c in kept]])

    def run(pages: paged.Pages) -> Iterator[pa.Table]:
        for u, v in paged.pairs(pages.bounds):
            u, v = u[pages.known[u]], v[pages.known[u]]
            sides = [pages.table.select(kept).take(at).rename_columns([f"{p}_{c}" for c in kept]) for p, at in (("a", u), ("b", v))]
            yield pa.table([pages.table.column("page_id").take(u), *sides[0].columns, *sides[1].columns], names=["page_id", *sides[0].column_names, *sides[1].column_names])

    return paged.mapped(paged.dealt(lines.select("page_id", *kept), ["page_id"], "line_id"), ["page_id"], run, schema)


def page_pairs(lines: DataFrame, *others: str) -> DataFrame:
    """All pairs u < v of a page as columns u, v, a_* and b_*, with their gap and the smaller font; others: more columns."""
    pairs = paired(lines, (*_KEPT, *others))
    return pairs.withColumns({"u": F.col("a_line_id"), "v": F.col("b_line_id"), "gap": geometry.gap("a", "b"), "fs": F.least("a_fs", "b_fs")})


Side = dict[str, np.ndarray]
#: What the tests of nearness look at.
TESTED = ("x", "y", "w", "h", "fs", "ar")


def sides(table: pa.Table, u: np.ndarray, v: np.ndarray, names: tuple[str, ...] = TESTED) -> tuple[Side, Side]:
    columns = {n: paged.numbers(table, n) for n in names}
    return {n: c[u] for n, c in columns.items()}, {n: c[v] for n, c in columns.items()}


def gap(a: Side, b: Side) -> np.ndarray:
    """geometry.gap(): a distance that is null does not count."""

    def along(at: str, size: str) -> np.ndarray:
        return np.fmax(np.fmax(0, b[at] - a[at] - a[size]), a[at] - b[at] - b[size])

    dx, dy = along("x", "w"), along("y", "h")
    return np.sqrt(dx * dx + dy * dy)


def opposed(one: np.ndarray, other: np.ndarray, aspect: float) -> np.ndarray:
    """Whether one line is wide where the other is tall; a null could be either."""
    wide = lambda x: ~(x <= aspect)
    tall = lambda x: ~(x >= 1 / aspect)
    return (wide(one) & tall(other)) | (wide(other) & tall(one))


def near(a: Side, b: Side, gap: np.ndarray, n: Nearness) -> np.ndarray:
    """The first tests: gap, font sizes, and not one line wide where the other is tall."""
    fs = np.fmin(a["fs"], b["fs"])
    return (gap <= n.discard * fs) & (np.fmax(a["fs"], b["fs"]) / fs <= n.font) & ~opposed(a["ar"], b["ar"], n.aspect)


def aligned(a: Side, b: Side, gap: np.ndarray, n: Nearness) -> np.ndarray:
    """The tests of two upright lines that are near: equal centres, or equal edges across the direction of writing."""
    fs = np.fmin(a["fs"], b["fs"])
    centre = np.abs(a["x"] + np.floor(a["w"] / 2) - b["x"] - np.floor(b["w"] / 2)) < n.edge

    def edges(at: str, size: str) -> np.ndarray:
        return np.fmin(np.abs(a[at] - b[at]), np.abs(a[at] + a[size] - b[at] - b[size])) < fs * n.edge

    wide_a, wide_b = a["w"] > a["h"] * n.ratio, b["w"] > b["h"] * n.ratio
    tall_a, tall_b = a["h"] > a["w"] * n.ratio, b["h"] > b["w"] * n.ratio
    by_edge = np.where(wide_a | wide_b, edges("x", "w"), (tall_a | tall_b) & edges("y", "h")) & ~((wide_a & tall_b) | (wide_b & tall_a))
    return (gap < fs * n.gap) & (centre | by_edge)


Test = Callable[[pa.Table, np.ndarray, np.ndarray], np.ndarray]


def is_near(n: Nearness) -> Test:
    def test(table: pa.Table, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        a, b = sides(table, u, v)
        return near(a, b, gap(a, b), n)

    return test


def is_edge(n: Nearness) -> Test:
    def test(table: pa.Table, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        a, b = sides(table, u, v)
        way = gap(a, b)
        kept = np.flatnonzero(near(a, b, way, n))
        kept = kept[aligned({k: x[kept] for k, x in a.items()}, {k: x[kept] for k, x in b.items()}, way[kept], n)]
        out = np.zeros(len(u), bool)
        out[kept] = True
        return out

    return test


def is_coarse(discard: float = 2, font: float = 0.7, turn: float = 15) -> Test:
    """Lines of one direction whose angles (deg) and fonts differ little and whose gap is within the larger font's reach."""

    def test(table: pa.Table, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        a, b = sides(table, u, v, ("x", "y", "w", "h", "fs", "deg"))
        way = table.column("direction").combine_chunks().dictionary_encode()
        kind = np.asarray(way.indices.fill_null(-1) if len(way) else [])
        alike = (kind[u] == kind[v]) & (kind[u] >= 0) & (np.abs(a["fs"] - b["fs"]) / np.fmin(a["fs"], b["fs"]) <= font)
        return alike & (np.abs(a["deg"] - b["deg"]) <= turn) & (gap(a, b) <= discard * np.fmax(a["fs"], b["fs"]))

    return test


def links(pages: paged.Pages, test: Test) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of a page that pass, in blocks; of a null page there are none."""
    for u, v in paged.pairs(pages.bounds):
        kept = test(pages.table, u, v) & pages.known[u]
        yield u[kept], v[kept]


def linked(pages: paged.Pages, test: Test) -> tuple[np.ndarray, np.ndarray]:
    found = [(np.zeros(0, int),) * 2, *links(pages, test)]
    return np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found])


def only(dealt: DataFrame, *others: str) -> DataFrame:
    """What the tests of nearness look at, and other columns: no more goes to Python."""
    return dealt.select("page_id", *[c for c in dealt.columns if c == "line_id"], *TESTED, *others)


def tested(dealt: DataFrame, test: Test, *others: str) -> DataFrame:
    """(page_id, u, v) of the pairs that pass; dealt: lines by page and in order, as from paged.dealt(); others: columns that the
    test looks at besides TESTED."""

    def run(pages: paged.Pages) -> Iterator[pa.Table]:
        ids = pages.ids().astype(np.int32)
        for u, v in links(pages, test):
            yield pa.table([pages.table.column("page_id").take(u), ids[u], ids[v]], names=["page_id", "u", "v"])

    return paged.mapped(only(dealt, *others), ["page_id"], run, f"page_id {dealt.schema['page_id'].dataType.simpleString()}, u int, v int")


def edges(lines: DataFrame, n: Nearness) -> DataFrame:
    return tested(paged.dealt(lines.select("page_id", "line_id", *TESTED), ["page_id"], "line_id"), is_edge(n))


#: Cells of a block along each side; lines of a block of more than DENSE meet by cells.
BLOCK, DENSE = 16, 64


def grid_edges(lines: DataFrame, n: Nearness, cell: int = 64) -> DataFrame:
    """edges() for pages of many lines: they are dealt out by page and block of cells.

    A line goes to each block that its box, widened by the discard gap, covers.  A pair is tested where the low corner of what
    the first line's widened box shares with the second's lies: that is one place, and both are there.
    """
    side = cell * BLOCK
    reach = F.col("fs") * n.discard

    def blocks(low: Column, high: Column) -> Column:
        at = lambda x: F.greatest(F.floor(x / side).cast("int"), F.lit(0))
        return F.sequence(at(low), at(high))

    rows = lines.select("page_id", "line_id", *TESTED, F.explode(blocks(F.col("x") - reach, F.col("x") + F.col("w") + reach)).alias("gx"), blocks(F.col("y") - reach, F.col("y") + F.col("h") + reach).alias("ys"))
    rows = rows.select("page_id", "line_id", *TESTED, "gx", F.explode("ys").alias("gy"))
    keys = ["page_id", "gx", "gy"]
    test = is_edge(n)

    def run(pages: paged.Pages) -> Iterator[pa.Table]:
        ids, c = paged.numbers(pages.table, "line_id", np.int32), {k: paged.numbers(pages.table, k) for k in (*TESTED, "gx", "gy")}
        wide = c["fs"] * n.discard

        def met(u: np.ndarray, v: np.ndarray, size: int, gx: np.ndarray, gy: np.ndarray) -> Iterator[pa.Table]:
            low = lambda at: np.maximum(np.floor(np.maximum(c[at][u] - wide[u], c[at][v]) / size), 0)
            kept = (low("x") == gx) & (low("y") == gy)
            u, v = u[kept], v[kept]
            kept = test(pages.table, u, v)
            u, v = u[kept], v[kept]
            yield pa.table([pages.table.column("page_id").take(u), ids[u], ids[v]], names=["page_id", "u", "v"])

        size = np.diff(pages.bounds)
        few = pages.known & np.repeat(size <= DENSE, size)
        for u, v in paged.pairs(pages.bounds):
            u, v = u[few[u]], v[few[u]]
            yield from met(u, v, side, c["gx"][u], c["gy"][u])
        many = np.flatnonzero(pages.known & ~few)
        group = np.repeat(np.arange(len(size)), size)[many]
        span = {}
        for at, length, g in (("x", "w", "gx"), ("y", "h", "gy")):
            low, high = (np.maximum(np.floor(e / cell), 0) for e in (c[at][many] - wide[many], c[at][many] + c[length][many] + wide[many]))
            first = c[g][many] * BLOCK
            span[at] = np.maximum(low, first).astype(int), np.minimum(high, first + BLOCK - 1).astype(int)
        across, down = (hi - lo + 1 for lo, hi in span.values())
        row = np.repeat(np.arange(len(many)), across * down)
        k = np.arange(len(row)) - np.repeat(np.cumsum(across * down) - across * down, across * down)
        gx, gy = span["x"][0][row] + k % across[row], span["y"][0][row] + k // across[row]
        order = np.lexsort((row, gy, gx, group[row]))
        row, gx, gy = row[order], gx[order], gy[order]
        new = np.flatnonzero(np.r_[True, (np.diff(group[row]) != 0) | (np.diff(gx) != 0) | (np.diff(gy) != 0)][: len(row)])
        for u, v in paged.pairs(np.r_[new, len(row)]) if len(row) else ():
            yield from met(many[row[u]], many[row[v]], cell, gx[u], gy[u])

    kind = lines.schema["page_id"].dataType.simpleString()
    return paged.mapped(paged.dealt(rows, keys, "line_id"), keys, run, f"page_id {kind}, u int, v int")
