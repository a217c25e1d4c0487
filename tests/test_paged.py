"""Whole pages as arrays: one shuffle a query, pages across batches, and pages of many lines."""

import duckdb
import numpy as np
import pytest

from layertext.operators import paged, pairs
from layertext.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Shuffles of each query: lines are dealt out by page once; for the grid they have line_ids first and go by block then.
SHUFFLES = {
    "component_edge_stats": 1, "mst_split": 1, "quad_distance": 1, "result_document": 1, "pair_merge_grid": 2, "jsx_block": 1, "quad_merge": 1, "region_text": 1, "quad_measures": 1,
    "region_angle_snap": 1, "region_direction": 1, "region_merge": 1, "split_small": 1, "region_alignment": 1, "region_colors": 1, "region_confidence": 1, "region_majority_direction": 1,
    "pair_distance": 1, "ocr_direction_groups": 1, "components": 1, "pair_merge_strict": 1,
}


@pytest.mark.parametrize("name", sorted(SHUFFLES))
def test_lines_are_shuffled_once(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == SHUFFLES[name]
    # no lambda over a page's lines, no window and no pages collected into rows
    assert not any(x in plan for x in ("collect_list", "Generate explode(filter")) and (name == "pair_merge_grid" or "Window" not in plan)


@pytest.mark.parametrize("name", ["region_merge", "region_text", "result_document", "mst_split", "quad_merge", "pair_merge_grid", "ocr_direction_groups"])
def test_pages_across_batches(spark, monkeypatch, name):
    rows = lambda: sorted(map(tuple, catalogue.QUERIES[name](spark, SF).collect()), key=repr)
    want = rows()
    monkeypatch.setattr(paged, "ROWS", 5)
    monkeypatch.setattr(paged, "PAIRS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert rows() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def lines(rng, n, page, spread):
    w, h = rng.integers(20, 110, n), rng.integers(10, 30, n)
    columns = [np.full(n, page), np.arange(n), rng.integers(-40, spread, n), rng.integers(-40, spread, n), w, h, np.minimum(w, h), w / h]
    return [tuple(x.item() for x in row) for row in zip(*columns, strict=True)]


def test_grid_equals_all_pairs_on_pages_of_many_lines(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [row for page, (n, spread) in enumerate([(400, 900), (300, 4000), (60, 200), (1, 10)]) for row in lines(rng, n, page, spread)]
    df = spark.createDataFrame(data, "page_id long, line_id int, x int, y int, w int, h int, fs int, ar double").repartition(5)
    monkeypatch.setattr(paged, "PAIRS", 1000)
    want = sorted(map(tuple, pairs.edges(df, pairs.MERGE).collect()))
    got = sorted(map(tuple, pairs.grid_edges(df, pairs.MERGE).collect()))
    assert len(want) > 500 and got == want
    assert sorted(map(tuple, pairs.grid_edges(df, pairs.MERGE, cell=16).collect())) == want


def test_roots_are_the_least_rows():
    rng = np.random.default_rng(5)
    for n, m in ((1, 0), (50, 30), (300, 260)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        want = np.arange(n)
        for _ in range(n):
            for a, b in zip(u, v, strict=True):
                want[[a, b]] = min(want[a], want[b])
        assert paged.roots(n, u, v).tolist() == want.tolist()


def test_pairs_in_bounded_blocks(monkeypatch):
    monkeypatch.setattr(paged, "PAIRS", 10)
    bounds = np.array([0, 0, 1, 5, 5, 16])
    blocks = list(paged.pairs(bounds))
    want = [(i, j) for a, b in zip(bounds[:-1], bounds[1:], strict=True) for i in range(a, b) for j in range(i + 1, b)]
    assert [p for u, v in blocks for p in zip(u.tolist(), v.tolist(), strict=True)] == want
    assert max(len(u) for u, _ in blocks) <= 10


def test_null_pages_and_values_as_in_sql(spark, tmp_path):
    """Lines of a null page are joined to none; a line without a part or a quantity keeps its region."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE lineitem AS SELECT * FROM '{SF}/lineitem.parquet' WHERE l_orderkey < 400")
    con.execute("UPDATE lineitem SET l_suppkey = NULL WHERE l_orderkey % 11 = 0 AND l_linenumber = 1")
    con.execute("UPDATE lineitem SET l_quantity = NULL WHERE l_orderkey % 13 = 0 AND l_linenumber = 2")
    con.execute("UPDATE lineitem SET l_orderkey = NULL WHERE l_orderkey BETWEEN 100 AND 103")
    con.execute(f"CREATE TABLE orders AS SELECT * FROM '{SF}/orders.parquet' WHERE o_orderkey < 380 UNION ALL SELECT * REPLACE (NULL AS o_orderkey) FROM '{SF}/orders.parquet' WHERE o_orderkey < 3")
    for t in ("lineitem", "orders"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    for name in ("pair_merge_strict", "pair_merge_grid", "quad_merge", "quad_distance", "component_edge_stats", "pair_distance", "split_small"):
        df = catalogue.QUERIES[name](spark, str(tmp_path))
        want = con.execute(catalogue.ORACLES[name])
        columns = [d[0] for d in want.description]
        assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(repr, want.fetchall())), name
    n = catalogue.QUERIES["result_document"](spark, str(tmp_path)).where("page_id is null").collect()
    assert {r.n_regions for r in n} == {0}


def test_pages_without_any_line(spark, tmp_path):
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(0).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{SF}/orders.parquet").limit(20).write.parquet(f"{tmp_path}/orders.parquet")
    assert [r.n_regions for r in catalogue.QUERIES["result_document"](spark, str(tmp_path)).collect()] == [0] * 20
    assert all(catalogue.QUERIES[n](spark, str(tmp_path)).count() == 0 for n in ("region_merge", "jsx_block", "mst_split", "quad_merge", "pair_merge_grid"))
