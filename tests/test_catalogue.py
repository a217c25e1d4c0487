"""Each registered query of the engine's own operators against its SQL, and hand-worked cases for what has none."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from layertext.functions import text
from layertext.operators import beam, graph, raster
from layertext.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("orders", "lineitem", "documents", "pages", "conversations", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = df.collect()
    assert got
    if name in catalogue.ORACLES:
        want = con.execute(catalogue.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert plain([[r[c] for c in columns] for r in got]) == plain(want.fetchall())


def test_joined_texts(spark):
    df = spark.createDataFrame([(["한국", "어", "漢字", "b", "c"],), (["one"],), ([],), (["a　", "b"],)], "t array<string>")
    assert [r[0] for r in df.select(text.joined(F.col("t"))).collect()] == ["한국 어漢字b c", "one", "", "a　b"]


def test_escape_and_natural_key(spark):
    df = spark.createDataFrame([("p10", 'a\\"\n\r\t')], "n string, t string")
    row = df.select(text.natural_key(F.col("n")), text.js_escape(F.col("t"))).first()
    assert row[0] == "p\x01" + "2".rjust(10, "0") + "10" and row[1] == 'a\\\\\\"\\r\\r\\t'


def test_split_cuts_the_outlier():
    x = np.array([0.0, 10, 20, 30, 40, 50, 200])
    dist = np.abs(x[:, None] - x[None, :])
    touch = np.zeros((7, 7), bool)
    fs = np.full(7, 10.0)
    groups = graph.split(dist, touch, fs, x, x * 7)
    assert sorted(map(sorted, groups)) == [[0, 1, 2, 3, 4, 5], [6]]
    assert graph.split(np.array([[0.0, 14], [14, 0]]), touch[:2, :2], fs[:2], x[:2], x[:2]) == [[0, 1]]
    assert graph.split(np.array([[0.0, 15], [15, 0]]), touch[:2, :2], fs[:2], x[:2], x[:2]) == [[0], [1]]


def test_labels_eight_neighbours():
    mask = np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0], [1, 0, 1]], bool)
    assert raster.label(mask).tolist() == [[0, -1, -1], [-1, 0, -1], [-1, -1, -1], [9, -1, 11]]


def brute_beam(steps, k):
    best = sorted(steps[0].items(), key=lambda x: (-x[1], x[0]))[:k]
    beams = [([t], s, t == 2) for t, s in best]
    for step in steps[1:]:
        if sum(b[2] for b in beams) >= 2:
            break
        ranked = sorted(step.items(), key=lambda x: (-x[1], x[0]))[:k]
        grown = [(-(s + (0 if e else g)), i, r, toks + [2 if e else t], e or t == 2) for i, (toks, s, e) in enumerate(beams) for r, (t, g) in enumerate(ranked)]
        beams = [(toks, -key, e) for key, _, _, toks, e in sorted(grown)[:k]]
    toks, s, e = beams[0]
    return " ".join(map(str, toks)), s, e


def test_beam_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    data = {v: [dict(enumerate(rng.integers(-900, 0, 16).tolist())) for _ in range(4)] for v in range(40)}
    rows = [(v, s, t, g) for v, steps in data.items() for s, step in enumerate(steps) for t, g in step.items()]
    out = beam.search(spark.createDataFrame(rows, "vec_id long, step int, tok int, lg long")).collect()
    assert {r.vec_id: (r.tokens, r.score, r.ended) for r in out} == {v: brute_beam(s, 5) for v, s in data.items()}


def test_spacing_gate_sees_what_lies_behind_40_characters(spark, tmp_path):
    turns = lambda end: [(1, 0, "user", "x" * 41 + end), (1, 1, "assistant", "x" * 50 + end)]
    out = []
    for end in "ab":
        spark.createDataFrame(turns(end), "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/{end}/conversations.parquet")
        out.append({r.digest for r in catalogue.QUERIES["spacing_gate"](spark, f"{tmp_path}/{end}").collect()})
    assert len(out[0]) == 2 and not out[0] & out[1]


def test_script_flags_judge_documents(spark, tmp_path):
    rows = [(1, "word مرحبا", "en"), (6, "word שלום", "en"), (2, "word 한국어", None), (3, "한국어", "en"), (4, None, "ko"), (5, "plain", "")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.rtl, r.korean) for r in catalogue.QUERIES["script_flags"](spark, str(tmp_path)).collect()}
    assert found == {1: (True, False), 6: (False, False), 2: (False, True), 3: (False, False), 4: (False, True), 5: (False, False)}


def test_names_sort_by_their_numbers(spark):
    names = ["p1", "p2", "P3", "p10", "p02x", "p" + "9" * 25, "p1" + "0" * 25, "10", "9a", "p", "p-1", "pa"]
    parts = lambda n: [int(c) if c.isdigit() else c.lower() for c in __import__("re").split(r"(\d+)", n)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(text.natural_key(F.col("n"))).collect()] == sorted(names, key=parts)


def test_digits_and_scripts(spark):
    import unicodedata

    tested = [chr(c) for c in [*range(32, 0x250), *range(0x2070, 0x20A0), *range(0x2460, 0x2500), *range(0x2776, 0x2794), 0x1371, 0x10A40, 0x10E60, 0x1F101] if unicodedata.category(chr(c)) != "Cn"]
    worth = lambda c: not (c.isdigit() or unicodedata.category(c)[0] == "P" or unicodedata.category(c) in ("Zs", "Cc", "Cf") or c in "$+<=>^`|~")
    df = spark.createDataFrame([(c,) for c in tested], "c string")
    assert {r.c for r in df.where(F.length(text.valuable(F.col("c"))) > 0).collect()} == {c for c in tested if worth(c)}
    edges = [(c, any(a <= c <= b for a, b in text.RTL_RANGES)) for a, b in text.RTL_RANGES for c in (a - 1, a, b, b + 1)] + [(0x05D0, False), (0x0710, False)]
    df = spark.createDataFrame([(chr(c), want) for c, want in edges if not 0xD800 <= c < 0xE000], "c string, want boolean")
    assert df.where(F.col("c").rlike(text.RTL) != F.col("want")).count() == 0
    rows = [("plain", "en"), ("한국어", "ko"), ("漢字かな", "ja"), ("漢字", "zh"), ("слово", "ru"), ("12 !", "")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert df.where(text.script_language(F.col("t")) != F.col("want")).count() == 0


def test_two_turned_lines_are_split():
    near = np.array([[0.0, 5], [5, 0]])
    touch, fs, at = np.ones((2, 2), bool), np.full(2, 10.0), np.zeros(2)
    assert graph.split(near, touch, fs, at, at, np.array([90.0, 120])) == [[0, 1]]
    assert graph.split(near, touch, fs, at, at, np.array([90.0, 126])) == [[0], [1]]


def test_pattern_distances_equal_the_column_function(spark):
    from layertext.operators import pairs
    from layertext.sources import derived
    from layertext.functions import geometry

    rows = derived.lines(spark, SF).where("page_id < 200")
    far = pairs.page_pairs(rows).select("page_id", "u", "v", geometry.pattern_distance("a", "b").alias("far")).collect()
    by = {}
    for r in rows.collect():
        by.setdefault(r.page_id, {})[r.line_id] = r
    for r in far:
        own = [by[r.page_id][i] for i in sorted(by[r.page_id])]
        matrix = graph.pattern_distances(*(np.array([x[c] for x in own], float) for c in "xywh"))
        assert matrix[r.u, r.v] == pytest.approx(r.far)


def test_parts_without_overlap_go_to_the_nearest_line():
    lines = np.array([[0, 0, 100, 20], [0, 40, 100, 20]], float)
    assert raster.owner(50, (10, 5, 10, 10), lines) == 0
    assert raster.owner(50, (10, 24, 10, 8), lines) == -1 and raster.owner(50, (10, 21, 10, 6), lines) == 0
    assert raster.owner(3000, (0, 0, 100, 30), lines) == -1
