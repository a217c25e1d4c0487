"""Turned quads: order of the corners and distances, against hand-worked cases and points along the sides."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from layertext.operators import quads


def rows(spark, data):
    return spark.createDataFrame([(1, i, [dict(x=x, y=y) for x, y in q]) for i, q in enumerate(data)], "page_id long, line_id int, quad array<struct<x:int,y:int>>")


def test_corners_in_any_order(spark):
    wide, tall = [(0, 0), (50, 4), (49, 14), (0, 10)], [(5, 0), (15, 1), (12, 60), (2, 59)]
    data = [list(p) for q in (wide, tall) for p in itertools.permutations(q)]
    found = quads.measured(rows(spark, data)).orderBy("line_id").collect()
    assert [r.vertical for r in found] == [False] * 24 + [True] * 24
    assert all([tuple(p) for p in r.quad] == q for r, q in zip(found, [wide] * 24 + [tall] * 24, strict=True))


def test_degenerate_quads_have_measures(spark):
    found = quads.measured(rows(spark, [[(3, 3)] * 4, [(0, 0), (9, 0), (9, 0), (0, 0)]])).orderBy("line_id").collect()
    assert [(r.area, r.fs, r.ratio, r.upright) for r in found] == [(0, 0, None, False), (0, 0, None, True)]
    assert quads.edges(quads.measured(rows(spark, [[(3, 3)] * 4] * 2)), quads.Nearness()).count() == 0
    assert quads.measured(rows(spark, [[(3, 3)] * 4]).limit(0)).count() == 0


def test_distances_equal_sampled_sides():
    rng = np.random.default_rng(3)
    centre = rng.uniform(0, 60, (300, 2, 1, 2))
    angle = rng.uniform(0, 3, (300, 2, 1)) + np.arange(4) * np.pi / 2
    q = centre + np.stack([np.cos(angle) * rng.uniform(2, 20, (300, 2, 1)), np.sin(angle) * rng.uniform(2, 20, (300, 2, 1))], -1)
    t = np.linspace(0, 1, 200)[:, None, None, None]
    sides = np.roll(q, -1, axis=2) - q
    found = quads.distances(q[:, 0], q[:, 1])
    for i in range(300):
        a, b = ((q[i, k] + t[..., 0, :] * sides[i, k]).reshape(-1, 2) for k in (0, 1))
        way = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).min()
        assert found[i] <= way + 1e-9
        assert found[i] == pytest.approx(way, abs=0.2) or found[i] == 0


def test_distances_of_touching_and_degenerate():
    unit = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    point = np.zeros((4, 2))
    cases = [(unit, unit + 1, 0), (unit, unit * 9 - 4, 0), (unit, unit + [3, 0], 2), (point, point + [3, 4], 5), (unit, point + [0.5, 0.5], 0)]
    assert quads.distances(*(np.stack([c[i] for c in cases]) for i in (0, 1))).tolist() == [c[2] for c in cases]


def test_turned_lines_join_by_angle(spark):
    def turned(cx, cy, degrees, w=60, h=14):
        a = np.radians(degrees)
        return [(round(cx + x * np.cos(a) - y * np.sin(a)), round(cy + x * np.sin(a) + y * np.cos(a))) for x, y in ((-w / 2, -h / 2), (w / 2, -h / 2), (w / 2, h / 2), (-w / 2, h / 2))]

    found = quads.edges(quads.measured(rows(spark, [turned(100, 100, 30), turned(110, 120, 32), turned(90, 140, 55), turned(400, 100, 30)])), quads.Nearness(aspect=1.3, font=2, edge=3, gap=1))
    assert [(r.u, r.v) for r in found.collect()] == [(0, 1)]


def test_min_rect_of_a_turned_square(spark):
    points = spark.createDataFrame([(1, x, y, 45.0, 10.0, 10.0) for x, y in ((10.0, 0.0), (20.0, 10.0), (10.0, 20.0), (0.0, 10.0))], "k int, x double, y double, angle double, cx double, cy double")
    quad = quads.min_rect(points, ["k"]).select(F.explode("quad").alias("q")).select("q.*").collect()
    assert sorted((r.x, r.y) for r in quad) == [(0, 10), (10, 0), (10, 20), (20, 10)]
