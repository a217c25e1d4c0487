"""Column functions on upright boxes.  A box is a prefix p with columns p_x, p_y, p_w, p_h and p_fs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gap(a: str, b: str) -> Column:
    """Distance between two boxes, 0 where they touch or overlap."""

    def along(at: str, size: str) -> Column:
        left = F.col(f"{b}_{at}") - F.col(f"{a}_{at}") - F.col(f"{a}_{size}")
        right = F.col(f"{a}_{at}") - F.col(f"{b}_{at}") - F.col(f"{b}_{size}")
        return F.greatest(F.lit(0), left, right).cast("double")

    dx, dy = along("x", "w"), along("y", "h")
    return F.sqrt(dx * dx + dy * dy)


def pattern_distance(a: str, b: str, rho: float = 0.5) -> Column:
    """Distance along the reading pattern of the first line: left, right or middle edges for `h`, top or bottom ones for `v`.

    The edge is chosen by the area that the two edges span over the font size: the first edge unless another is nearer
    than rho fonts and spans less.
    """
    c = {f"{p}{n}": F.col(f"{p}_{n}") for p in (a, b) for n in ("x", "y", "w", "h")}
    ax, ay, aw, ah, bx, by, bw, bh = (c[f"{p}{n}"] for p in (a, b) for n in ("x", "y", "w", "h"))
    fs = F.least(F.col(f"{a}_fs"), F.col(f"{b}_fs"))
    high, wide = (ah + bh) / 2, (aw + bw) / 2
    amid, bmid = F.floor(ax + aw / 2), F.floor(bx + bw / 2)

    def far(x: Column, y: Column) -> Column:
        return F.sqrt((x * x + y * y).cast("double"))

    left, right, middle = high * F.abs(ax - bx) / fs, high * F.abs(ax + aw - bx - bw) / fs, high * F.abs(amid - bmid) / fs
    across = F.when((right < fs * rho) & (right < left), 1).otherwise(0)
    across = F.when((middle < fs * rho) & (middle < left) & (middle < right), 2).otherwise(across)
    horizontal = F.when(across == 0, far(ax - bx, ay - by)).when(across == 1, far(ax + aw - bx - bw, ay - by)).otherwise(far(amid - bmid, ay - by))
    top, bottom = wide * F.abs(ay - by) / fs, wide * F.abs(ay + ah - by - bh) / fs
    vertical = F.when((bottom < fs * rho) & (bottom < top), far(ax + aw - bx - bw, ay + ah - by - bh)).otherwise(far(ax - bx, ay - by))
    return F.when(F.col(f"{a}_direction") == "h", horizontal).otherwise(vertical)


def rotated(x: Column, y: Column, cx: Column, cy: Column, degrees: Column) -> tuple[Column, Column]:
    """The point (x, y) turned about (cx, cy), in doubles; y grows downwards."""
    a = F.radians(degrees)
    dx, dy = x - cx, y - cy
    return dy * F.sin(a) + dx * F.cos(a) + cx, dy * F.cos(a) - dx * F.sin(a) + cy


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point from a segment; a segment without length is its first point."""
    dx, dy = (x2 - x1).cast("double"), (y2 - y1).cast("double")
    along = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    at = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    far_x, far_y = px - x1 - at * dx, py - y1 - at * dy
    return F.sqrt(far_x * far_x + far_y * far_y)


def extended(at: Column, size: Column, limit: Column, by: Column) -> tuple[Column, Column]:
    """Start and size of one side of a box that grows by `by` both ways within 0..limit - 1."""
    start = F.greatest(at - by, F.lit(0))
    return start, F.least(size + by * 2, limit - start - 1)


def needs_tiles(width: Column, height: Column, target: int) -> Column:
    """Whether an image is too long and too narrow to be detected at once."""
    long, short = F.greatest(width, height), F.least(width, height)
    return (long / target > 2.5) & (F.try_divide(long, short) > 3)


def alignment(n_lines: Column, direction: Column) -> Column:
    return F.when((n_lines == 1) | (direction == "h"), "center").when(direction == "hr", "right").otherwise("left")
