"""Quadrilaterals that may be turned: order of the corners, measures, distances and the joins of near lines.

A quad is an array of four structs (x, y).  Order, measures and distances are computed on arrays of many quads; the boxes
around two quads rule out the pairs that are far apart before their distance is looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layertext.functions import geometry
from layertext.operators import paged, pairs
from layertext.operators.pairs import Nearness

#: Lines within this cosine of an axis count as upright; turned lines join within this angle and font difference.
UPRIGHT, ANGLE, FONT = 0.05, math.radians(15), 0.25


Measures = dict[str, np.ndarray]


def _sorted(points: np.ndarray, first: int) -> np.ndarray:
    """[n, k, 2]: the points of each row by one coordinate, then the other."""
    order = np.lexsort((points[..., 1 - first], points[..., first]), axis=-1)
    return np.take_along_axis(points, order[..., None], axis=1)


def is_vertical(q: np.ndarray) -> np.ndarray:
    """Whether the two long sides, of the six connections those third and fourth by length, run down rather than across."""
    ends = np.stack([q[:, j] - q[:, i] for i, j in combinations(range(4), 2)], axis=1)
    order = np.lexsort((ends[..., 1], ends[..., 0], (ends * ends).sum(-1)), axis=-1)
    one, other = (ends[np.arange(len(q)), order[:, k]] for k in (2, 3))
    sign = np.where((one * other).sum(-1) < 0, -1, 1)
    return np.abs(one[:, 0] * sign + other[:, 0]) <= np.abs(one[:, 1] * sign + other[:, 1])


def ordered(q: np.ndarray, vertical: np.ndarray) -> np.ndarray:
    """The corners from the top left on, clockwise: paired from the top down where vertical, else from left to right."""
    down, across = _sorted(q, 1), _sorted(q, 0)
    top, bottom = _sorted(down[:, :2], 0), _sorted(down[:, 2:], 0)
    left, right = _sorted(across[:, :2], 1), _sorted(across[:, 2:], 1)
    upright = np.stack([top[:, 0], top[:, 1], bottom[:, 1], bottom[:, 0]], axis=1)
    return np.where(vertical[:, None, None], upright, np.stack([left[:, 0], right[:, 0], right[:, 1], left[:, 1]], axis=1))


def measures(q: np.ndarray) -> Measures:
    """Of quads [n, 4, 2]: vertical, the corners in order as quad, and the measures of the two lines between middles of sides.

    ratio (across over down; NaN where a quad has no height), fs (the shorter of the two), angle in radians from 0 to pi,
    upright, area, and the box x, y, w, h.  A quad of NaN has NaN.
    """
    vertical = is_vertical(q)
    q = ordered(q, vertical)
    after = np.roll(q, -1, axis=1)
    middle = np.trunc((q + after) / 2)
    down, over = middle[:, 2] - middle[:, 0], middle[:, 3] - middle[:, 1]
    dl, ol = (np.sqrt((run * run).sum(-1)) for run in (down, over))
    low, high = q.min(axis=1), q.max(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        cosines = np.concatenate([down / dl[:, None], over / ol[:, None]], axis=1)
        ratio = np.where(dl > 0, ol / dl, np.nan)
    angle = np.fmod(np.arccos(np.fmax(np.fmin(cosines[:, 0], 1.0), -1.0)), math.pi)
    area = np.abs((q[..., 0] * after[..., 1] - after[..., 0] * q[..., 1]).sum(-1)) / 2
    box = dict(zip("xywh", [*low.T, *(high - low).T], strict=True))
    return {"vertical": vertical, "quad": q, "ratio": ratio, "fs": np.fmin(dl, ol), "angle": np.where(np.isnan(dl), np.nan, angle), "upright": (np.abs(cosines) < UPRIGHT).any(axis=1), "area": area, **box}


def measured(quads: DataFrame) -> DataFrame:
    """quads (quad) with the columns of measures(); NaN is null, and columns of those names are replaced."""
    point = quads.schema["quad"].dataType.elementType
    kind = point["x"].dataType.simpleString()
    schema = f"vertical boolean, quad array<double>, ratio double, fs double, angle double, upright boolean, area double, {', '.join(f'{c} double' for c in 'xywh')}"

    @F.pandas_udf(f"struct<{schema}>")
    def found(*corners: pd.Series) -> pd.DataFrame:
        q = np.stack([c.to_numpy(float) for c in corners], axis=1).reshape(-1, 4, 2)
        m, gone = measures(q), np.isnan(q).any(axis=(1, 2))
        out = pd.DataFrame({c: list(x.reshape(-1, 8)) if c == "quad" else x for c, x in m.items()})
        out["vertical"] = out["vertical"].astype(object).where(~gone, None)
        return out

    corners = [F.col("quad")[i][axis].cast("double") for i in range(4) for axis in "xy"]
    rows = quads.withColumn("__m", found(*corners))
    at = lambda c: F.col("__m")[c]
    quad = F.when(at("vertical").isNotNull(), F.array(*[F.struct(*[at("quad")[2 * i + k].cast(kind).alias(axis) for k, axis in enumerate("xy")]) for i in range(4)]))
    plain = {c: F.nanvl(at(c), F.lit(None)) for c in ("ratio", "fs", "angle", "area")} | {c: F.nanvl(at(c), F.lit(None)).cast(kind) for c in "xywh"}
    return rows.withColumns({"vertical": at("vertical"), "quad": quad, "upright": at("upright"), **plain}).drop("__m")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """[n]: distances of the convex quads a and b, [n, 4, 2]; 0 where they touch or overlap."""

    def sides(q: np.ndarray) -> np.ndarray:
        return np.roll(q, -1, axis=1) - q

    def to_sides(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        run = sides(q)[:, None]
        off = p[:, :, None] - q[:, None]
        square = np.maximum((run * run).sum(-1), 1e-12)
        at = np.clip((off * run).sum(-1) / square, 0, 1)
        return np.sqrt(((off - at[..., None] * run) ** 2).sum(-1)).min(axis=(1, 2))

    along = np.concatenate([sides(a), sides(b), np.broadcast_to([[1.0, 0.0]], (len(a), 1, 2))], axis=1)
    axes = np.concatenate([along, along[..., ::-1] * [1, -1]], axis=1)
    on_a, on_b = (np.einsum("nkd,npd->nkp", axes, q) for q in (a, b))
    apart = ((on_a.max(-1) < on_b.min(-1)) | (on_b.max(-1) < on_a.min(-1))).any(-1)
    return np.where(apart, np.minimum(to_sides(a, b), to_sides(b, a)), 0.0)


Reader = Callable[[paged.Pages], Measures]


def read(pages: paged.Pages) -> Measures:
    """The measures that measured() has made."""
    table = pages.table
    corners = table.column("quad").combine_chunks()
    there = np.asarray(corners.is_valid())
    q = np.full((len(table), 4, 2), np.nan)
    q[there] = np.stack([np.asarray(x, float) for x in corners.flatten().flatten()], axis=-1).reshape(-1, 4, 2)
    upright = np.asarray(table.column("upright").combine_chunks().fill_null(False))
    return {"quad": q, "upright": upright, **{c: paged.numbers(table, c) for c in ("ratio", "fs", "angle", "x", "y", "w", "h")}}


def near(pages: paged.Pages, m: Measures, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows u < v of a page whose quads are at most `reach` smaller fonts apart, and their distance, in blocks.

    The boxes' distance, never above the quads', goes first.
    """
    for u, v in paged.pairs(pages.bounds):
        u, v = u[pages.known[u]], v[pages.known[u]]
        a, b = ({c: m[c][at] for c in "xywh"} for at in (u, v))
        kept = pairs.gap(a, b) <= np.fmin(m["fs"][u], m["fs"][v]) * reach
        u, v = u[kept], v[kept]
        if not len(u):
            continue
        far = distances(m["quad"][u], m["quad"][v])
        kept = far <= np.fmin(m["fs"][u], m["fs"][v]) * reach
        yield u[kept], v[kept], far[kept]


def near_pairs(dealt: DataFrame, reader: Reader, reach: float) -> DataFrame:
    """(page_id, u, v, gap) of near(); dealt: quads by page and in order, as from paged.dealt()."""

    def run(pages: paged.Pages) -> Iterator[pa.Table]:
        ids = pages.ids().astype(np.int32)
        for u, v, far in near(pages, reader(pages), reach):
            yield pa.table([pages.table.column("page_id").take(pa.array(u)), ids[u], ids[v], far], names=["page_id", "u", "v", "gap"])

    return paged.mapped(dealt, ["page_id"], run, f"page_id {dealt.schema['page_id'].dataType.simpleString()}, u int, v int, gap double")


def merged(dealt: DataFrame, reader: Reader, n: Nearness) -> DataFrame:
    """(page_id, u, v) of the lines that belong together: pairs of upright quads by their edges, others by angle and font."""

    def run(pages: paged.Pages) -> Iterator[pa.Table]:
        ids, m = pages.ids().astype(np.int32), reader(pages)
        for u, v, far in near(pages, m, n.discard):
            a, b = ({c: m[c][at] for c in ("x", "y", "w", "h", "fs", "ratio", "angle")} for at in (u, v))
            fs = np.fmin(a["fs"], b["fs"])
            turned = (np.abs(a["angle"] - b["angle"]) < ANGLE) & (far <= fs * n.edge) & (np.abs(a["fs"] - b["fs"]) <= fs * FONT)
            joined = np.where(m["upright"][u] & m["upright"][v], pairs.aligned(a, b, far, n), turned)
            kept = joined & (np.fmax(a["fs"], b["fs"]) <= fs * n.font) & ~pairs.opposed(a["ratio"], b["ratio"], n.aspect)
            yield pa.table([pages.table.column("page_id").take(pa.array(u[kept])), ids[u[kept]], ids[v[kept]]], names=["page_id", "u", "v"])

    return paged.mapped(dealt, ["page_id"], run, f"page_id {dealt.schema['page_id'].dataType.simpleString()}, u int, v int")


def edges(quads: DataFrame, n: Nearness) -> DataFrame:
    """merged() of quads with line_id and the columns of measured()."""
    rows = quads.select("page_id", "line_id", "quad", "ratio", "fs", "angle", "upright", "x", "y", "w", "h")
    return merged(paged.dealt(rows, ["page_id"], "line_id"), read, n)


def all_measures(dealt: DataFrame, reader: Reader) -> DataFrame:
    """page_id, line_id and the measures, but for the corners, of each quad."""
    names = ("vertical", "ratio", "fs", "angle", "upright", "area", "x", "y", "w", "h")
    kinds = {"vertical": "boolean", "upright": "boolean", **{c: "int" for c in "xywh"}}

    def run(pages: paged.Pages) -> Iterator[pa.Table]:
        m = reader(pages)
        gone = np.isnan(m["quad"]).any(axis=(1, 2))
        columns = [pa.array(m[c], mask=None if c == "upright" else gone if m[c].dtype == bool else np.isnan(m[c])) for c in names]
        columns = [c.cast(pa.int32()) if n in "xywh" else c for n, c in zip(names, columns, strict=True)]
        yield pa.table([pages.table.column("page_id"), pages.ids().astype(np.int32), *columns], names=["page_id", "line_id", *names])

    kind = dealt.schema["page_id"].dataType.simpleString()
    return paged.mapped(dealt, ["page_id"], run, f"page_id {kind}, line_id int, " + ", ".join(f"{c} {kinds.get(c, 'double')}" for c in names))


def min_rect(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, with the box of the points (x, y, angle, cx, cy) of each key in the frame turned by its angle, turned back.

    angle is in degrees about (cx, cy), the same for all points of a key.  Corners are truncated and not below 0.
    """
    x, y = geometry.rotated(*[F.col(c) for c in ("x", "y", "cx", "cy")], F.col("angle"))
    flat = points.withColumns({"__x": F.round(x, 9), "__y": F.round(y, 9)})
    box = flat.groupBy(*keys, "angle", "cx", "cy").agg(F.min("__x").alias("l"), F.max("__x").alias("r"), F.min("__y").alias("t"), F.max("__y").alias("b"))
    corners = []
    for at_x, at_y in (("l", "t"), ("r", "t"), ("r", "b"), ("l", "b")):
        turned = geometry.rotated(F.col(at_x), F.col(at_y), F.col("cx"), F.col("cy"), -F.col("angle"))
        corners.append(F.struct(*[F.greatest(F.lit(0), F.round(c, 6).cast("int")).alias(n) for n, c in zip("xy", turned, strict=True)]))
    return box.select(*keys, F.array(*corners).alias("quad"))
