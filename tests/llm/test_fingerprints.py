import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from layertext.llm import fingerprints as fp


def cuts(text):
    return Counter(line[i : i + fp.CELL] for line in text.encode().split(b"\n") for i in range(0, len(line), fp.CELL))


def near(a, b):
    a, b = cuts(a), cuts(b)
    both = sum((a & b).values())
    every = sum((a | b).values())
    return both / every if every else 1.0


def texts(n=60, seed=2):
    r = random.Random(seed)
    lines = ["".join(r.choice("abc é\U0001f600") for _ in range(r.choice([0, 5, 64, 200]))) for _ in range(40)]
    return ["\n".join(r.choice(lines) for _ in range(r.choice([0, 1, 5, 40]))) for _ in range(n)]


def test_differences_are_exact():
    a, b = texts(seed=3), texts(seed=4)
    x, y = fp.elements([t.encode() for t in a]), fp.elements([t.encode() for t in b])
    got = fp.differences(*x, *y)
    want = [sum(((cuts(s) - cuts(t)) + (cuts(t) - cuts(s))).values()) for s, t in zip(a, b, strict=True)]
    assert got.tolist() == want


def test_changes_are_the_elements_that_differ(monkeypatch):
    a, b = texts(seed=5), texts(seed=6)
    x, y = fp.elements([t.encode() for t in a]), fp.elements([t.encode() for t in b])
    want = []
    for i in range(len(a)):
        mine, other = (set(e[at[i] : at[i + 1]].tolist()) for e, at in (x, y))
        want += [(i, e, 1) for e in mine - other] + [(i, e, -1) for e in other - mine]
    got = lambda: sorted(zip(*(c.tolist() for c in fp.changes(*x, *y)), strict=True))
    assert got() == sorted(want)
    peel = fp.Sketches.peel
    monkeypatch.setattr(fp.Sketches, "peel", lambda self: (*peel(self)[:3], np.zeros(len(self.cells), bool)))  # never succeeds
    assert got() == sorted(want)


def test_peeling_ends_where_cells_only_seem_pure():
    sketch = fp.Sketches(np.array([12, 12]))
    sketch.count[:] = 1
    sketch.key[:] = np.arange(24, dtype=np.uint64)
    sketch.check[:] = fp.mix(np.arange(24, dtype=np.uint64))
    assert not sketch.peel()[3].any()


def test_peeling_recovers_elements():
    a, bounds = fp.elements([b"one\ntwo\nthree"])
    sketch = fp.Sketches(np.array([48]))
    sketch.add(np.zeros(len(a), int), a, np.ones(len(a), np.int64))
    _, x, sign, done = sketch.peel()
    assert done.all() and set(x) == set(a) and (sign == 1).all()


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_ROWS", 7)
    rows = [(i * 3, t) for i, t in enumerate(texts())] + [(1000, None), (1001, "x" * 9), (1002, "x" * 9)]
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id long, text string").selectExpr("*", "1 as bucket", "2 as key")
    out = {r.doc_id: r for r in fp.fingerprints(df).collect()}
    assert len(out) == len(rows)
    for i, (d, t) in enumerate(rows):
        t, u = t or "", rows[(i + 1) % len(rows)][1] or ""
        changed = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        r = out[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        apart = sum(((cuts(t) - cuts(changed)) + (cuts(changed) - cuts(t))).values())
        assert len(r.removed) + len(r.added) == apart
        assert r.near_edited == pytest.approx(near(t, changed)) and r.near_next == pytest.approx(near(t, u))
    assert out[1001].fingerprint == out[1002].fingerprint and out[1001].near_next == 1


def test_few(spark):
    df = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    (r,) = fp.fingerprints(df).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abca").hexdigest() and r.near_next == 1
    assert fp.fingerprints(df.limit(0)).collect() == []
    many = spark.createDataFrame([(None, "a"), (5, "b"), (5, "c"), (5, "b")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in fp.fingerprints(many).collect()) == ["5", "5", "5", "None"]
