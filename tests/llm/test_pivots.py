import math
import random

from layertext.llm import pivots


def brute(rows, k=5, every=50):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asks = {}
    for i, v in kept:
        if i % every == 0:
            asks[i] = min(asks.get(i, v), v)
    out = []
    for q, v in asks.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in kept if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "2 as cell", "3 as score")
    assert sorted(tuple(r) for r in pivots.top_products(df).collect()) == brute(rows)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivots, "BLOCK", 64)
    r = random.Random(6)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(9)]
    rows = [(i, [c + r.gauss(0, 0.1) for c in r.choice(centres)]) for i in range(900)]
    rows += [(2000 + i, list(centres[0])) for i in range(300)] + [(3000, [0.0] * 8), (3050, [-1.0] * 8)]
    rows += [(50, None), (None, [1.0] * 8), (100, [None] * 8), (150, [math.nan] * 8), (200, [math.inf] * 8), (250, []), (7, [0.5, 0.25]), (0, [9.0] * 8), (1, [9.0] * 8), (1, [9.0] * 8)]
    check(spark, rows)


def test_few(spark):
    check(spark, [(0, [1.0, 2.0])])
    check(spark, [(0, [1.0, 2.0]), (3, [1.0, -2.0]), (50, [0.0, 0.0])])
    check(spark, [])


def test_bounds_stop_the_search_of_clustered_vectors(spark, monkeypatch):
    r = random.Random(2)
    monkeypatch.setattr(pivots, "ANNULI", 6)
    centres = [[r.gauss(0, 1) for _ in range(16)] for _ in range(24)]
    rows = [(i, [c + r.gauss(0, 0.03) for c in r.choice(centres)]) for i in range(3000)]
    share: list = []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(x) for x in pivots.top_products(df, searched=share).collect()) == brute(rows)
    whole, *rounds = share
    assert sum(x["vectors"] for x in rounds) < 0.5 * whole["queries"] * whole["vectors"]
    assert sum(x["cells"] for x in rounds) < 0.5 * whole["queries"] * whole["cells"]
