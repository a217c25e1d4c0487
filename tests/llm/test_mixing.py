import random

import pytest
from pyspark.sql import functions as F

from layertext.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        out = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if out[s] > most * sizes[s]]
        if not over:
            return fixed | out
        fixed |= {s: most * sizes[s] for s in over}


def documents(n=3000, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        source = r.choice(["hot"] * 8 + ["a", "b", "z", "\U0001f600", "￮", None])
        rows.append((i, " ".join("x" for _ in range(r.choice([0, 3, 40, 90, 2000 if i % 97 == 0 else 7]))) if i % 50 else None, source))
    return rows


def test_targets_and_sizes(spark):
    rows = documents()
    out = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == len(rows)
    size = {s: 0 for _, _, s in rows}
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want = brute_targets(size)
    longest = max(len((t or "").split()) for _, t, _ in rows)
    taken = dict.fromkeys(size, 0)
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert r.size <= r.source_size and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= longest / 2 + 1


def test_mix_repeats_rows_and_reruns_agree(spark):
    df = spark.createDataFrame(documents(400), "doc_id long, text string, source string").withColumn("rank", F.lit(1)).withColumn("__size", F.lit("x")).withColumn("whole", F.lit(2))
    first, second = mixing.mix(df), mixing.mix(df)
    assert first.columns == df.columns
    a, b = sorted(map(tuple, first.collect()), key=repr), sorted(map(tuple, second.collect()), key=repr)
    assert a == b
    plan = mixing.mixture(df).collect()
    assert len(a) == sum(r.copies for r in plan)


def test_long_documents_are_likelier_and_heavy_ones_certain(spark):
    r = random.Random(1)
    rows = [(i, "x " * (400 if i % 10 == 0 else 100 if i % 2 else 25), "s" if i < 4000 else "t") for i in range(5000)]
    rows += [(9000 + i, "x " * 100_000, "s") for i in range(2)]
    r.shuffle(rows)
    out = [x for x in mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 2)).collect() if x.source == "s"]
    base = min(x.copies for x in out)
    rate = {n: sum(x.copies - base for x in out if x.size == n) / sum(x.size == n for x in out) for n in (25, 100, 400, 100_000)}
    assert rate[100_000] == 1  # their chance would be above 1
    # the chances of the others are in proportion to the root of their words
    assert abs(rate[100] / rate[25] - 2) < 0.4 and abs(rate[400] / rate[100] - 2) < 0.4
    assert abs(sum(x.taken for x in out) - out[0].target) <= 400


def brute_mixture(rows, hashed):
    """Which rows are taken, from the chances and ranks as they are defined."""
    size = {i: len((t or "").split()) for i, t, _ in rows}
    total = {}
    for i, _, s in rows:
        total[s] = total.get(s, 0) + size[i]
    want, copies = brute_targets(total), {}
    for s in total:
        ids = [i for i, _, x in rows if x == s]
        whole = int(want[s] / total[s] + 1e-12)
        rest = float(round(want[s])) - whole * total[s]
        certain = set()
        while True:
            free = [i for i in ids if i not in certain]
            left = rest - sum(size[i] for i in certain)
            scale = left / sum(size[i] * size[i] ** 0.5 for i in free) if left > 0 and any(size[i] for i in free) else 0
            more = {i for i in free if size[i] and size[i] ** 0.5 * scale >= 1}
            if not more:
                break
            certain |= more
        odds = lambda p: p / (1 - p)
        ranked = sorted((odds(hashed[i][0]) / odds(min(max(size[i] ** 0.5 * scale, 1e-12), 1 - 1e-12)), hashed[i][1], i) for i in free if size[i])
        best, taken, chosen = abs(left), 0, 0
        for n, (_, _, i) in enumerate(ranked, 1):
            taken += size[i]
            if abs(taken - left) < best:
                best, chosen = abs(taken - left), n
        sampled = {i for _, _, i in ranked[:chosen]} if left > 0 else set()
        copies |= {i: whole + (i in certain or i in sampled) for i in ids}
    return copies


def test_the_taken_documents_equal_brute_force(spark):
    r = random.Random(21)
    rows = [(i, "x " * r.choice([1, 5, 9, 40, 300, 2000 if i % 50 == 0 else 20]), r.choice(["a", "a", "a", "b", "c", "d"])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashed = {x.doc_id: (x["__u"], x["__tie"]) for x in df.select("doc_id", *[e.alias(c) for c, e in mixing._sampled(df, None, 1).items()]).collect()}
    assert {x.doc_id: x.copies for x in mixing.mixture(df).collect()} == brute_mixture(rows, hashed)


def test_weights_change_the_odds(spark):
    rows = [(i, "a b c", "s" if i < 2000 else "t", 9.0 if i % 2 else 1.0) for i in range(3000)]
    out = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string, w double"), weights=(1, 3), weight="w").where("source = 's'").collect()
    odd = sum(r.copies for r in out if r.doc_id % 2)
    even = sum(r.copies for r in out if not r.doc_id % 2)
    assert odd > 2 * even and abs(sum(r.taken for r in out) - out[0].target) <= 3


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mixture(df).collect() == [] and mixing.mix(df).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mixture(blank).collect()] == [0, 0]
