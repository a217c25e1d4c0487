"""Operators on rasters kept as rows (vec_id, py, px, p)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segmented(pixels: DataFrame, threshold: int = 127) -> DataFrame:
    """Counts and mean of the pixels over the threshold."""
    over = F.col("p") > threshold
    return pixels.groupBy("vec_id").agg(F.count_if(over).alias("n_over"), F.sum(F.when(over, F.col("p"))).alias("sum_over"), F.round(F.avg("p"), 6).alias("mean_p"))


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected components of a mask, each named by its least flat index; -1 elsewhere.

    Every step takes the neighbours' least name and then that cell's own name, so names travel ever further.
    """
    h, w = mask.shape
    out = np.where(mask, np.arange(h * w).reshape(h, w), -1)
    while True:
        grid = np.full((h + 2, w + 2), h * w)
        grid[1:-1, 1:-1] = np.where(mask, out, h * w)
        least = np.min([grid[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        new = np.where(mask, least, -1)
        new[mask] = new.ravel()[new[mask]]
        if (new == out).all():
            return out
        out = new


def pixel_components(pixels: DataFrame, threshold: int = 127, side: int = 8) -> DataFrame:
    """(vec_id, comp, area, x, y, width, height): the components of each map and their boxes."""

    @F.pandas_udf("array<int>")
    def labelled(ps: pd.Series) -> pd.Series:
        return pd.Series([label(np.asarray(p).reshape(side, side) > threshold).ravel().tolist() for p in ps])

    rows = pixels.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct((F.col("py") * side + F.col("px")).alias("i"), "p"))).alias("m"))
    cells = rows.select("vec_id", F.posexplode(labelled("m.p")).alias("i", "comp")).where("comp >= 0")
    px, py = F.col("i") % side, F.floor(F.col("i") / side).cast("int")
    return cells.groupBy("vec_id", "comp").agg(
        F.count("*").alias("area"), F.min(px).alias("x"), F.min(py).alias("y"), (F.max(px) - F.min(px) + 1).alias("width"), (F.max(py) - F.min(py) + 1).alias("height")
    )


def box_scores(pixels: DataFrame, least: float = 0.5) -> DataFrame:
    """Mean probability of each quadrant, and whether it reaches the least score."""
    rows = pixels.groupBy("vec_id", F.floor(F.col("py") / 4).cast("int").alias("by"), F.floor(F.col("px") / 4).cast("int").alias("bx"))
    rows = rows.agg(F.sum("p").alias("total"), F.count("*").alias("n"))
    score = F.col("total") / (F.col("n") * 255)
    return rows.select("vec_id", "by", "bx", F.round(score, 9).alias("score"), (F.col("total") >= F.col("n") * 255 * least).alias("kept"))


def composite(pixels: DataFrame, threshold: int = 127) -> DataFrame:
    """Each map over the next one by id, the last over the first: the next one's pixel where the mask is set.

    A map is one array, so maps are joined, not pixels.  Ids run from 0 on without gaps.
    """
    maps = pixels.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("py", "px", "p"))).alias("m")).select("vec_id", F.col("m.p").alias("p"))
    count = maps.select(F.count("*").alias("n"))  # one row
    after = maps.join(F.broadcast(count)).select(F.pmod(F.col("vec_id") - 1, "n").alias("vec_id"), F.col("p").alias("q"))
    over = lambda p, q: F.when(p > threshold, q).otherwise(p)
    total = F.aggregate(F.zip_with("p", "q", over), F.lit(0).cast("long"), lambda a, x: a + x)
    return maps.join(after, "vec_id").select("vec_id", total.alias("total"), F.size(F.filter("p", lambda p: p > threshold)).cast("long").alias("masked"))


def owner(area: int, part: tuple[int, int, int, int], lines: np.ndarray, kept: float = 0.01) -> int:
    """The line (x, y, w, h) that a part of a mask, of so many pixels in the box x, y, w, h, belongs to; -1 for none.

    It is the line that the part's box overlaps most by its share of the smaller area, if that is above `kept`, else the one
    nearest to the box's middle, within half the text size; ties to the first.  Parts that are not smaller than the line
    that they overlap most are none's.
    """
    start, end = lines[:, :2], lines[:, :2] + lines[:, 2:]
    low, high = np.array(part[:2]), np.array(part[:2]) + np.array(part[2:])
    areas = lines[:, 2:].prod(1)
    share = np.clip(np.minimum(end, high) - np.maximum(start, low), 0, None).prod(1) / np.minimum(area, np.maximum(areas, 1))
    line = int(np.argmax(share))
    if area >= areas[line]:
        return -1
    if share[line] > kept:
        return line
    middle = (low + high) / 2
    far = np.hypot(*np.maximum(0, np.maximum(start - middle, middle - end)).T)
    line = int(np.argmin(far))
    return line if far[line] < 0.5 * max(min(lines[line, 2:].min(), *part[2:]), 10) else -1


def assigned(components: DataFrame, boxes: DataFrame, least: int = 9) -> DataFrame:
    """(vec_id, comp, line_id) of the components of more than `least` pixels: the box that each belongs to by owner(), or null.

    components: vec_id, comp, area, x, y, width, height.  boxes: vec_id, line_id, x, y, w, h.
    """
    parts = components.where(F.col("area") > least).groupBy("vec_id").agg(F.collect_list(F.struct("comp", "area", "x", "y", "width", "height")).alias("c"))
    lines = boxes.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("line_id", "x", "y", "w", "h"))).alias("b"))

    @F.pandas_udf("array<int>")
    def found(areas: pd.Series, xs: pd.Series, ys: pd.Series, ws: pd.Series, hs: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for a, *part, bx, by, bw, bh in zip(areas, xs, ys, ws, hs, x, y, w, h, strict=True):
            box = np.stack([bx, by, bw, bh], 1).astype(float) if bx is not None and len(bx) else None
            out.append([-1 if box is None else owner(int(k), tuple(int(v) for v in p), box) for k, *p in zip(a, *part, strict=True)])
        return pd.Series(out)

    rows = parts.join(lines, "vec_id", "left")
    rows = rows.select("vec_id", "c", "b", found("c.area", "c.x", "c.y", "c.width", "c.height", "b.x", "b.y", "b.w", "b.h").alias("at"))
    rows = rows.select("vec_id", "b", F.explode(F.arrays_zip(F.col("c.comp").alias("comp"), "at")).alias("z"))
    return rows.select("vec_id", "z.comp", F.when(F.col("z.at") >= 0, F.get("b.line_id", F.col("z.at"))).alias("line_id"))
