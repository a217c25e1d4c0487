"""Regions: the lines of a component, aggregated."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layertext.functions import text
from layertext.operators import paged, pairs

KEYS = ["page_id", "comp"]


#: What each column of a region is made from.
_FROM = {
    "x": ["x"], "y": ["y"], "width": ["x", "w"], "height": ["y", "h"], "n_lines": [], "font_size": ["fs"], "confidence": ["prob", "area"], "dir": ["direction", "ar"],
    "text": ["direction", "ar", "cx", "cy", "txt"], "direction": ["ar", "area"], "angle": ["deg"], "fg": ["fg"], "bg": ["bg"],
}
#: The columns of _measured() that it takes, with their types; those of boxes have the types of the lines'.
_RAW = {
    "n_lines": {"n_lines": "long"}, "font_size": {"font_size": "double"}, "confidence": {"weight": "double", "page_area": "double"}, "dir": {"dir": "string"},
    "text": {"texts": "array<string>"}, "direction": {"direction": "string"}, "angle": {"deg": "double"},
    **{c: {f"{c}_{i}": "int" for i in range(3)} for c in ("fg", "bg")}, **{c: {c: "double"} for c in ("x", "y", "width", "height")},
}


def _prepared(lines: DataFrame, names: list[str], *others: str) -> DataFrame:
    """The columns of lines that _measured() looks at for these names, and others that lines has."""
    needed = {c for n in names for c in _FROM[n]} | {c for c in others if c in lines.columns}
    plain = [c for c in lines.columns if c in needed - {"fg", "bg", "prob"}]
    shades = [F.col(c)[i].alias(f"{c}_{i}") for c in ("fg", "bg") if c in needed for i in range(3)]
    return lines.select(*plain, *shades, *[(F.ln("prob") * F.col("area")).alias("weight") for _ in ("prob",) if "prob" in needed])


def _measured(pages: paged.Pages, root: np.ndarray, names: list[str]) -> tuple[np.ndarray, list[pa.Array]]:
    """The first line of each region, in order, and the columns _RAW of the regions that the lines with equal root make up."""
    table = pages.table
    order, starts = paged.grouped(root)
    sizes = np.diff(np.r_[starts, len(order)])
    group = np.repeat(np.arange(len(starts)), sizes)
    number = lambda c: paged.numbers(table, c)[order]
    known = lambda x: pa.array(x, mask=np.isnan(x))

    def summed(c: str) -> tuple[np.ndarray, np.ndarray]:
        """The sum of what is not null, and how many that are."""
        column = table.column(c).combine_chunks()
        there = np.asarray(column.is_valid())
        x = np.asarray(column.fill_null(0) if column.null_count else column)[order].astype(float)
        return np.add.reduceat(x, starts), np.add.reduceat(there[order].astype(int), starts)

    def mean(c: str) -> pa.Array:
        total, n = summed(c)
        return pa.array(total / np.maximum(n, 1), mask=n == 0)

    def shade(c: str) -> pa.Array:
        total, n = summed(c)
        return pa.array(np.rint(total / np.maximum(n, 1)).astype(np.int32), mask=n == 0)

    def first_of(group: np.ndarray, *keys: np.ndarray) -> np.ndarray:
        """Of each group the place of the row whose keys, the last one first, are the least, nulls last."""
        by = np.lexsort((*keys, group))
        return by[np.flatnonzero(np.r_[True, np.diff(group[by]) != 0][: len(by)])]

    out: dict[str, pa.Array] = {}
    if {"dir", "text"} & set(names):
        way = table.column("direction").combine_chunks().take(pa.array(order))
        across = np.add.reduceat(np.asarray(pc.equal(way, "h").fill_null(False)).astype(int), starts) * 2 - sizes
        lead = starts.copy()
        tied = np.flatnonzero((across == 0)[group])
        if len(tied):
            ar = number("ar")[tied]
            place = first_of(group[tied], tied, -np.round(np.fmax(ar, 1 / ar), 9))
            lead[group[tied[place]]] = tied[place]
        dirs = pc.if_else(pa.array(across > 0), "h", pc.if_else(pa.array(across < 0), "v", way.take(pa.array(lead))))
    for n in names:
        if n in ("x", "y"):
            out[n] = known(np.fmin.reduceat(number(n), starts))
        elif n in ("width", "height"):
            at, size = ("x", "w") if n == "width" else ("y", "h")
            out[n] = known(np.fmax.reduceat(number(at) + number(size), starts) - np.fmin.reduceat(number(at), starts))
        elif n == "n_lines":
            out[n] = pa.array(sizes)
        elif n == "font_size":
            out[n] = known(np.fmin.reduceat(number("fs"), starts))
        elif n == "confidence":
            total, some = summed("weight")
            area = paged.numbers(table, "area")
            page = np.repeat(np.arange(len(pages.bounds) - 1), np.diff(pages.bounds))
            whole = np.bincount(page, weights=np.nan_to_num(area))
            any_ = np.bincount(page, weights=~np.isnan(area))
            of = page[order[starts]]
            out["weight"], out["page_area"] = pa.array(total, mask=some == 0), pa.array(whole[of], mask=any_[of] == 0)
        elif n == "dir":
            out[n] = dirs
        elif n == "text":
            across_ = np.asarray(pc.equal(dirs, "h").fill_null(False))[group]
            key = np.where(across_, number("cy"), -number("cx"))
            by = np.lexsort((order, np.where(np.isnan(key), -np.inf, key), group))
            out["texts"] = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(order)].astype(np.int32)), table.column("txt").combine_chunks().take(pa.array(order[by])))
        elif n == "direction":
            lead = first_of(group, np.arange(len(order)), -number("area"))
            out[n] = pa.array(np.where(number("ar")[lead] < 1, "v", "h"))
        elif n == "angle":
            out["deg"] = mean("deg")
        else:
            out |= {f"{n}_{i}": shade(f"{n}_{i}") for i in range(3)}
    return order[starts], [out[c] for n in names for c in _RAW[n]]


def _finished(at: Callable[[str], Column], names: list[str], kinds: dict[str, str]) -> list[Column]:
    """The columns of a region from those of _measured(); at gives one of these."""
    made: list[Column] = []
    for n in names:
        if n in kinds:
            c = at(n).cast(kinds[n])
        elif n == "font_size":
            c = at(n).cast("int")
        elif n == "confidence":
            c = F.round(F.exp(at("weight") / at("page_area")), 6)
        elif n == "text":
            c = F.when(F.size(at("texts")) == 1, at("texts")[0]).otherwise(text.joined(at("texts")))
        elif n == "angle":
            off = F.round(at("deg") - 90, 6)
            c = F.when(F.abs(off) < 3, 0.0).otherwise(off)
        elif n in ("fg", "bg"):
            c = F.array(*[at(f"{n}_{i}") for i in range(3)])
        else:
            c = at(n)
        made.append(c.alias(n))
    return made


def _kinds(lines: DataFrame, names: list[str]) -> dict[str, str]:
    sides = {"x": "x", "y": "y", "width": F.col("x") + F.col("w"), "height": F.col("y") + F.col("h")}
    return {n: lines.select(sides[n]).schema[0].dataType.simpleString() for n in names if n in sides}


def _raw_schema(names: list[str]) -> dict[str, str]:
    return {c: kind for n in names for c, kind in _RAW[n].items()}


def all_columns(lines: DataFrame, names: list[str] | None = None) -> DataFrame:
    """page_id, comp and every column of the regions that lines (with comp) make up.

    x, y, width, height; n_lines; font_size (the least); confidence (weighted by the areas of the whole page); dir (the most
    frequent direction; a tie goes to the line that is longest for its width, then the first); text (the lines' texts in
    reading order, joined); direction (`v` if the largest line, the first of equals, is higher than wide); angle (degrees off
    upright; under 3 they count as none); fg and bg (mean colours of three channels, halves to the even neighbour).
    names: only these, which spares the others' work.
    """
    names = names or [n for n in _FROM]
    schema = {c: lines.schema[c].dataType.simpleString() for c in KEYS} | _raw_schema(names)

    def run(pages: paged.Pages) -> Iterator[pa.Table]:
        root = np.maximum.accumulate(np.where(paged.begins(pages.table, KEYS), np.arange(len(pages.table)), 0))
        first, columns = _measured(pages, root, names)
        yield pa.table([*[pages.table.column(c).take(pa.array(first)) for c in KEYS], *columns], names=[*schema])

    dealt = paged.dealt(_prepared(lines, names, *KEYS, "line_id"), ["page_id"], "comp", "line_id")
    found = paged.mapped(dealt, ["page_id"], run, ", ".join(f"{c} {kind}" for c, kind in schema.items()))
    return found.select(*KEYS, *_finished(F.col, names, _kinds(lines, names)))


def of_linked(dealt: DataFrame, test: pairs.Test, names: list[str]) -> DataFrame:
    """page_id, comp and these columns of all_columns() of the regions of lines by page and in order, as from paged.dealt(),
    that the test joins."""
    schema = {"page_id": dealt.schema["page_id"].dataType.simpleString(), "comp": "int"} | _raw_schema(names)

    def run(pages: paged.Pages) -> Iterator[pa.Table]:
        first, columns = _measured(pages, paged.roots(len(pages.table), *pairs.linked(pages, test)), names)
        yield pa.table([pages.table.column("page_id").take(pa.array(first)), pages.ids().astype(np.int32)[first], *columns], names=[*schema])

    rows = _prepared(dealt, names, "page_id", "line_id", *pairs.TESTED)
    found = paged.mapped(rows, ["page_id"], run, ", ".join(f"{c} {kind}" for c, kind in schema.items()))
    return found.select(*KEYS, *_finished(F.col, names, _kinds(dealt, names)))


def listed(dealt: DataFrame, test: pairs.Test, names: list[str]) -> DataFrame:
    """(page_id, regions): the regions of of_linked() of each page, in order.

    Where dealt has a column page, its rows that have it true stand for a page each and come after the page's lines: each has
    its page's regions, none where there are no lines or the page is null; a page without such a row has none.
    """
    schema, marked = _raw_schema(names), "page" in dealt.columns

    def run(pages: paged.Pages) -> Iterator[pa.Table]:
        table, bounds = pages.table, pages.bounds
        each = np.ones(len(bounds) - 1, int)
        ids = table.column("page_id").take(pa.array(bounds[:-1]))
        if marked:
            mark = table.column("page").to_numpy()
            each = np.add.reduceat(mark.astype(int), bounds[:-1])
            line = ~mark & pages.known
            table, bounds = table.filter(pa.array(line)).combine_chunks(), np.r_[0, np.cumsum(np.add.reduceat(line.astype(int), bounds[:-1]))]
            pages = paged.Pages(table, bounds, np.ones(len(table), bool))
        if len(table):
            first, columns = _measured(pages, paged.roots(len(table), *pairs.linked(pages, test)), names)
            found = pa.StructArray.from_arrays(columns, names=[*schema])
        else:
            first, found = np.zeros(0, int), pa.nulls(0)
        cut = pa.array(np.searchsorted(first, bounds).astype(np.int32))
        repeat = pa.array(np.repeat(np.arange(len(each)), each))
        if not len(table):
            if len(repeat):
                yield pa.table([ids.take(repeat), pa.nulls(len(repeat))], names=["page_id", "regions"])
            return
        yield pa.table([ids.take(repeat), pa.ListArray.from_arrays(cut, found).take(repeat)], names=["page_id", "regions"])

    rows = _prepared(dealt, names, "page_id", "line_id", "page", *pairs.TESTED)
    inner = ", ".join(f"{c}: {kind}" for c, kind in schema.items())
    kind = dealt.schema["page_id"].dataType.simpleString()
    found = paged.mapped(rows, ["page_id"], run, f"page_id {kind}, regions array<struct<{inner}>>")
    kinds = _kinds(dealt, names)
    return found.select("page_id", F.transform(F.coalesce("regions", F.array()), lambda r: F.struct(*_finished(lambda c: r[c], names, kinds))).alias("regions"))


def reading_order_linked(dealt: DataFrame, test: pairs.Test) -> DataFrame:
    """(page_id, comp, line_id, dir, place) of reading_order() of lines by page and in order that the test joins."""

    def run(pages: paged.Pages) -> Iterator[pa.Table]:
        table, ids = pages.table, pages.ids().astype(np.int32)
        root = paged.roots(len(ids), *pairs.linked(pages, test))
        order, starts = paged.grouped(root)
        sizes = np.diff(np.r_[starts, len(order)])
        group = np.repeat(np.arange(len(starts)), sizes)
        way = table.column("direction").combine_chunks().take(pa.array(order))
        across = np.add.reduceat(np.asarray(pc.equal(way, "h").fill_null(False)).astype(int), starts) * 2 - sizes
        dirs = pc.if_else(pa.array(across > 0), "h", pc.if_else(pa.array(across < 0), "v", way.take(pa.array(starts)))).take(pa.array(group))
        x, y, w, h = (paged.numbers(table, c)[order] for c in "xywh")
        key = np.where(np.asarray(pc.equal(dirs, "h").fill_null(False)), y + np.floor(h / 2), -(x + w))
        by = np.lexsort((order, np.where(np.isnan(key), -np.inf, key), group))
        place = (np.arange(len(order)) - np.repeat(starts, sizes) + 1).astype(np.int32)
        row = order[by]
        yield pa.table([table.column("page_id").take(pa.array(row)), ids[root[row]], ids[row], dirs.take(pa.array(by)), place], names=["page_id", "comp", "line_id", "dir", "place"])

    kind = dealt.schema["page_id"].dataType.simpleString()
    rows = _prepared(dealt, [], "page_id", "line_id", "direction", *pairs.TESTED)
    return paged.mapped(rows, ["page_id"], run, f"page_id {kind}, comp int, line_id int, dir string, place int")


def reading_order(lines: DataFrame) -> DataFrame:
    """lines with comp, with dir (the most frequent direction of the group; a tie goes to the one that comes first) and place:
    their order in reading.

    Horizontal groups go down by the middles of their boxes, vertical ones to the left by the boxes' right edges.
    """
    group = Window.partitionBy(*KEYS)
    nh, n = F.count_if(F.col("direction") == "h").over(group) * 2, F.count("*").over(group)
    first = F.min(F.struct("line_id", "direction")).over(group)["direction"]
    rows = lines.withColumn("dir", F.when(nh > n, "h").when(nh < n, "v").otherwise(first))
    key = F.when(F.col("dir") == "h", F.col("y") + F.floor(F.col("h") / 2)).otherwise(-(F.col("x") + F.col("w")))
    return rows.withColumn("place", F.row_number().over(group.orderBy(key, "line_id")))


def documents(dealt: DataFrame, test: pairs.Test) -> DataFrame:
    """One JSON document for each row of dealt whose column page is true, with the page's regions in order; pages without lines
    keep an empty list.  For the others see listed()."""
    region = ["text", "x", "y", "width", "height", "angle", "font_size", "fg", "bg", "direction", "confidence"]
    found = listed(dealt, test, region)
    fixed = {"alignment": F.lit("left"), "line_spacing": F.lit(1.0), "letter_spacing": F.lit(1.0)}
    names = [*region[:-1], "alignment", "confidence", "line_spacing", "letter_spacing"]
    regions = F.transform("regions", lambda r: F.struct(*[fixed.get(n, r[n]).alias(n) for n in names]))
    return found.select("page_id", F.size("regions").alias("n_regions"), F.to_json(F.struct("page_id", regions.alias("regions"))).alias("document"))
