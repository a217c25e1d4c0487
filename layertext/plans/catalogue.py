"""The registered queries of the engine's own operators, each with its SQL for DuckDB where there is one."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layertext.functions import geometry, text
from layertext.operators import beam, graph, language, pairs, quads, raster, regions
from layertext.plans import extraction
from layertext.sources import derived, layered
from layertext.sources.derived import LINES, LOGITS, PIXELS, QUADS, dealt_lines, lines, logits, pixels, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# pairs of a page, and the tests of nearness, in SQL
_GAP = "sqrt(greatest(0, b.x - a.x - a.w, a.x - b.x - b.w) ** 2 + greatest(0, b.y - a.y - a.h, a.y - b.y - b.h) ** 2)"
PAIRS = f"""{LINES}, pairs AS (SELECT a.page_id, a.line_id AS u, b.line_id AS v, {_GAP} AS gap, least(a.fs, b.fs) AS fs, greatest(a.fs, b.fs) AS fs2, a.ar AS ar1, b.ar AS ar2,
a.x AS x1, a.y AS y1, a.w AS w1, a.h AS h1, b.x AS x2, b.y AS y2, b.w AS w2, b.h AS h2, a.direction AS d1, b.direction AS d2, abs(a.deg - b.deg) AS turn FROM lines a JOIN lines b ON a.page_id = b.page_id AND a.line_id < b.line_id)"""


def _near_sql(n: pairs.Nearness) -> str:
    return f"gap <= {n.discard} * fs AND fs2 / fs <= {n.font} AND NOT (ar1 > {n.aspect} AND ar2 < 1 / {n.aspect}::DOUBLE) AND NOT (ar2 > {n.aspect} AND ar1 < 1 / {n.aspect}::DOUBLE)"


def _edge_sql(n: pairs.Nearness) -> str:
    r = n.ratio
    return f"""{_near_sql(n)} AND gap < fs * {n.gap} AND (abs(x1 + w1 // 2 - (x2 + w2 // 2)) < {n.edge} OR CASE
WHEN (w1 > h1 * {r} AND h2 > w2 * {r}) OR (w2 > h2 * {r} AND h1 > w1 * {r}) THEN false
WHEN w1 > h1 * {r} OR w2 > h2 * {r} THEN abs(x1 - x2) < fs * {n.edge} OR abs(x1 + w1 - x2 - w2) < fs * {n.edge}
WHEN h1 > w1 * {r} OR h2 > w2 * {r} THEN abs(y1 - y2) < fs * {n.edge} OR abs(y1 + h1 - y2 - h2) < fs * {n.edge} ELSE false END)"""


def _comps_sql(n: pairs.Nearness) -> str:
    return f"""{PAIRS}, e AS (SELECT page_id, u, v FROM pairs WHERE {_edge_sql(n)}), both_ AS (SELECT * FROM e UNION ALL SELECT page_id, v, u FROM e),
reach(page_id, a, b) AS (SELECT page_id, line_id, line_id FROM lines UNION SELECT r.page_id, r.a, e.v FROM reach r JOIN both_ e ON r.page_id = e.page_id AND r.b = e.u),
comps AS (SELECT page_id, a AS line_id, min(b) AS comp FROM reach GROUP BY 1, 2), m AS (SELECT l.*, c.comp FROM lines l JOIN comps c USING (page_id, line_id))"""


MERGED, READ = _comps_sql(pairs.MERGE), _comps_sql(pairs.READ)


MERGE_TEST, READ_TEST = pairs.is_edge(pairs.MERGE), pairs.is_edge(pairs.READ)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH RECURSIVE {MERGED} SELECT page_id, comp, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS width, max(y + h) - min(y) AS height, count(*) AS n_lines, min(fs) AS font_size, round(exp(sum(ln(prob) * area) / any_value(pa)), 6) AS confidence FROM (SELECT *, sum(area) OVER (PARTITION BY page_id) AS pa FROM m) GROUP BY 1, 2")
def region_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.of_linked(dealt_lines(spark, sf_dir), MERGE_TEST, ["x", "y", "width", "height", "n_lines", "font_size", "confidence"])


@query(f"WITH RECURSIVE {MERGED} SELECT page_id, comp, round(exp(sum(ln(prob) * area) / any_value(pa)), 6) AS confidence FROM (SELECT *, sum(area) OVER (PARTITION BY page_id) AS pa FROM m) GROUP BY 1, 2")
def region_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.of_linked(dealt_lines(spark, sf_dir), MERGE_TEST, ["confidence"])


@query(f"WITH {LINES} SELECT page_id, line_id, x, y, w, h, fs, round(ar, 6) AS ar, direction, area, cx, cy FROM lines")
def lines_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("page_id", "line_id", "x", "y", "w", "h", "fs", F.round("ar", 6).alias("ar"), "direction", "area", "cx", "cy")


_NAME = "regexp_extract(url, '/([^/?]+)[^/]*$', 1)"


# a run of digits stands after its length, every other run ends with U+0001
_RUNS = r"list_transform(regexp_extract_all(lower({0}), '\d+|\D+'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN lpad(CAST(length(ltrim(p, '0')) AS VARCHAR), 10, '0') || ltrim(p, '0') ELSE p || chr(1) END)"
_KEY = r"CASE WHEN regexp_matches({0}, '^\d') THEN chr(1) ELSE '' END || coalesce(list_aggregate(" + _RUNS + ", 'string_agg', ''), '')"


@query(f"WITH n AS (SELECT page_id, {_NAME} AS name, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder FROM pages) SELECT page_id, {_KEY.format('name')} AS natural_key, lower(regexp_extract(name, '(\\.[^./]+)$', 1)) IN {text.EXTENSIONS} AS image, CAST(row_number() OVER (PARTITION BY folder ORDER BY encode({_KEY.format('name')}), page_id) AS INTEGER) AS place FROM n")
def image_listing_natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = text.file_name(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^(.*)/[^/]*$", 1).alias("folder"), text.natural_key(name).alias("natural_key"), text.is_image(name).alias("image"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy("natural_key", "page_id"))).drop("folder")


@query(f"SELECT page_id, {_NAME} AS name FROM pages")
def filename_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.file_name(F.col("url")).alias("name"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"""WITH w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS word FROM documents),
c AS (SELECT lang, word, count(*) AS n FROM w WHERE lang IS NOT NULL GROUP BY 1, 2), p AS (SELECT lang AS guess, word FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM c) WHERE r <= {language.WORDS}),
s AS (SELECT doc_id, guess, count(*) AS hits FROM w JOIN p USING (word) GROUP BY 1, 2), b AS (SELECT doc_id, guess FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, guess) AS r FROM s) WHERE r = 1)
SELECT d.doc_id, d.lang, coalesce(b.guess, '') AS guess FROM documents d LEFT JOIN b USING (doc_id)""")
def lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language.guessed(docs, language.profiles(docs)).select("doc_id", "lang", "guess")


@query(f"WITH {PAIRS} SELECT page_id, u, v FROM pairs WHERE {_near_sql(pairs.MERGE)}")
def pair_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.tested(dealt_lines(spark, sf_dir), pairs.is_near(pairs.MERGE))


@query(f"WITH {PAIRS} SELECT page_id, u, v FROM pairs WHERE {_edge_sql(pairs.MERGE)}")
def pair_merge_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.tested(dealt_lines(spark, sf_dir), MERGE_TEST)


@query(f"WITH {PAIRS} SELECT page_id, u, v FROM pairs WHERE {_edge_sql(pairs.MERGE)}")
def pair_merge_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.grid_edges(lines(spark, sf_dir), pairs.MERGE)


@query(f"WITH {PAIRS} SELECT page_id, u, v FROM pairs WHERE {_edge_sql(pairs.READ)}")
def pair_merge_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.tested(dealt_lines(spark, sf_dir), READ_TEST)


@query(f"WITH {PAIRS} SELECT page_id, u, v FROM pairs WHERE d1 = d2 AND (fs2 - fs) / fs <= 0.7 AND turn <= 15 AND gap <= 2 * fs2")
def pair_merge_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.tested(dealt_lines(spark, sf_dir), pairs.is_coarse(), "direction", "deg")


@query(f"WITH {PAIRS} SELECT page_id, u, v, round(gap, 6) AS gap FROM pairs")
def rect_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.page_pairs(lines(spark, sf_dir)).select("page_id", "u", "v", F.round("gap", 6).alias("gap"))


@query(f"WITH RECURSIVE {MERGED} SELECT page_id, line_id, comp FROM comps")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components_of(dealt_lines(spark, sf_dir), MERGE_TEST)


@query(f"""WITH RECURSIVE {READ}, g AS (SELECT *, count(*) FILTER (direction = 'h') OVER c AS nh, count(*) OVER c AS n, first_value(direction) OVER (PARTITION BY page_id, comp ORDER BY line_id) AS f FROM m WINDOW c AS (PARTITION BY page_id, comp)),
d AS (SELECT *, CASE WHEN nh * 2 > n THEN 'h' WHEN nh * 2 < n THEN 'v' ELSE f END AS dir FROM g)
SELECT page_id, comp, line_id, dir, CAST(row_number() OVER (PARTITION BY page_id, comp ORDER BY CASE WHEN dir = 'h' THEN y + h // 2 ELSE -(x + w) END, line_id) AS INTEGER) AS place FROM d""")
def ocr_direction_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.reading_order_linked(dealt_lines(spark, sf_dir), READ_TEST)


_PATTERN = """CASE WHEN d1 = 'h' THEN CASE WHEN mid < fs * 0.5 AND mid < lft AND mid < rgt THEN sqrt((x1 + w1 // 2 - x2 - w2 // 2) ** 2 + (y1 - y2) ** 2)
WHEN rgt < fs * 0.5 AND rgt < lft THEN sqrt((x1 + w1 - x2 - w2) ** 2 + (y1 - y2) ** 2) ELSE sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) END
ELSE CASE WHEN bot < fs * 0.5 AND bot < top_ THEN sqrt((x1 + w1 - x2 - w2) ** 2 + (y1 + h1 - y2 - h2) ** 2) ELSE sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) END END"""
_DISTANCES = f"""inside AS (SELECT p.*, c.comp FROM pairs p JOIN comps c ON p.page_id = c.page_id AND p.u = c.line_id JOIN comps d ON p.page_id = d.page_id AND p.v = d.line_id AND c.comp = d.comp),
areas AS (SELECT *, (h1 + h2) / 2 * abs(x1 - x2) / fs AS lft, (h1 + h2) / 2 * abs(x1 + w1 - x2 - w2) / fs AS rgt, (h1 + h2) / 2 * abs(x1 + w1 // 2 - x2 - w2 // 2) / fs AS mid,
(w1 + w2) / 2 * abs(y1 - y2) / fs AS top_, (w1 + w2) / 2 * abs(y1 + h1 - y2 - h2) / fs AS bot FROM inside), dist AS (SELECT *, {_PATTERN} AS far FROM areas)"""


@query(f"WITH RECURSIVE {MERGED}, {_DISTANCES} SELECT page_id, comp, u, v, round(far, 6) AS far FROM dist")
def pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.inside(dealt_lines(spark, sf_dir), MERGE_TEST).select("page_id", "comp", "u", "v", F.round("far", 6).alias("far"))


# an edge is in the least tree if nothing but later edges connects its ends
_TREE = f"""{_DISTANCES}, d AS (SELECT page_id, comp, u, v, far, row_number() OVER (PARTITION BY page_id, comp ORDER BY far, u, v) AS r FROM dist),
way AS (SELECT page_id, comp, u, v, r FROM d UNION ALL SELECT page_id, comp, v, u, r FROM d),
found(page_id, comp, r, u, v, here) AS (SELECT page_id, comp, r, u, v, u FROM d UNION SELECT f.page_id, f.comp, f.r, f.u, f.v, w.v FROM found f JOIN way w ON f.page_id = w.page_id AND f.comp = w.comp AND f.here = w.u AND w.r < f.r),
tree AS (SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.page_id = d.page_id AND f.comp = d.comp AND f.r = d.r AND f.here = d.v))"""


@query(f"WITH RECURSIVE {MERGED}, {_TREE} SELECT page_id, comp, CAST(count(*) AS INTEGER) AS n, round(avg(far), 6) AS mean_far, round(stddev_pop(far), 6) AS std_far FROM tree GROUP BY 1, 2")
def component_edge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.tree_stats(dealt_lines(spark, sf_dir), MERGE_TEST)


@query(f"WITH RECURSIVE {MERGED}, {_DISTANCES}, two AS (SELECT page_id, comp FROM m GROUP BY 1, 2 HAVING count(*) = 2) SELECT page_id, comp, far < 1.5 * fs2 AND turn < 36 AS kept FROM dist JOIN two USING (page_id, comp)")
def split_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.inside(dealt_lines(spark, sf_dir), MERGE_TEST).where("n = 2")
    return rows.select("page_id", "comp", ((F.col("far") < 1.5 * F.col("fs2")) & (F.col("turn") < 36)).alias("kept"))


@query()
def mst_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.split_linked(dealt_lines(spark, sf_dir), MERGE_TEST)


@query(f"WITH RECURSIVE {MERGED} SELECT page_id, comp, CAST(round_even(avg(fg[1]), 0) AS INTEGER) AS fg_r, CAST(round_even(avg(fg[2]), 0) AS INTEGER) AS fg_g, CAST(round_even(avg(fg[3]), 0) AS INTEGER) AS fg_b, CAST(round_even(avg(bg[1]), 0) AS INTEGER) AS bg_r, CAST(round_even(avg(bg[2]), 0) AS INTEGER) AS bg_g, CAST(round_even(avg(bg[3]), 0) AS INTEGER) AS bg_b FROM m GROUP BY 1, 2")
def region_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions.of_linked(dealt_lines(spark, sf_dir), MERGE_TEST, ["fg", "bg"])
    return rows.select(*regions.KEYS, *[F.col(c)[i].alias(f"{c}_{n}") for c in ("fg", "bg") for i, n in enumerate("rgb")])


_MAJORITY = """g AS (SELECT *, count(*) FILTER (direction = 'h') OVER c AS nh, count(*) OVER c AS n, first_value(direction) OVER (PARTITION BY page_id, comp ORDER BY round(greatest(ar, 1 / ar), 9) DESC, line_id) AS f FROM m WINDOW c AS (PARTITION BY page_id, comp)),
d AS (SELECT *, CASE WHEN nh * 2 > n THEN 'h' WHEN nh * 2 < n THEN 'v' ELSE f END AS dir FROM g)"""


@query(f"WITH RECURSIVE {MERGED}, {_MAJORITY} SELECT DISTINCT page_id, comp, dir FROM d")
def region_majority_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.of_linked(dealt_lines(spark, sf_dir), MERGE_TEST, ["dir"])


_TEXTS = "SELECT page_id, comp, string_agg(txt, ' ' ORDER BY CASE WHEN dir = 'h' THEN cy ELSE -cx END, line_id) AS text FROM d GROUP BY 1, 2"


@query(f"WITH RECURSIVE {MERGED}, {_MAJORITY} {_TEXTS}")
def region_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.of_linked(dealt_lines(spark, sf_dir), MERGE_TEST, ["text"])


@query(f"WITH RECURSIVE {MERGED}, t AS (SELECT *, row_number() OVER (PARTITION BY page_id, comp ORDER BY area DESC, line_id) AS r FROM m) SELECT page_id, comp, CASE WHEN ar < 1 THEN 'v' ELSE 'h' END AS direction FROM t WHERE r = 1")
def region_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.of_linked(dealt_lines(spark, sf_dir), MERGE_TEST, ["direction"])


@query(f"WITH RECURSIVE {MERGED}, t AS (SELECT page_id, comp, round(avg(deg) - 90, 6) AS a FROM m GROUP BY 1, 2) SELECT page_id, comp, CASE WHEN abs(a) < 3 THEN 0.0::DOUBLE ELSE a END AS angle FROM t")
def region_angle_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.of_linked(dealt_lines(spark, sf_dir), MERGE_TEST, ["angle"])


#: A page's sides in pixels, for the rules that compare with the image.
_PAGE = (150, 230)


@query(f"WITH {LINES} SELECT page_id, line_id, prob - 0.1 >= {extraction.Limits.read} AS sure, trim(txt) <> '' AS filled, least(w, h) >= 5 AS wide_enough, area > 16 AS large_enough, NOT (x >= {_PAGE[0]} AND y >= {_PAGE[1]}) AS inside, least(w * 9, h * 9) < 400 AS bordered, greatest(w, h) * 80.0 / {extraction.Limits.side} > 2.5 AND greatest(w, h) > 3 * least(w, h) AS tiled FROM lines")
def line_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return lines(spark, sf_dir).select(
        "page_id", "line_id", (c("prob") - 0.1 >= extraction.Limits.read).alias("sure"), c("txt").rlike("(?U)\\S").alias("filled"), (F.least("w", "h") >= 5).alias("wide_enough"),
        (c("area") > 16).alias("large_enough"), (~((c("x") >= _PAGE[0]) & (c("y") >= _PAGE[1]))).alias("inside"), (F.least(c("w") * 9, c("h") * 9) < 400).alias("bordered"),
        geometry.needs_tiles(c("w") * 80, c("h") * 80, extraction.Limits.side).alias("tiled"),
    )


@query(f"""WITH {LINES}, s AS (SELECT page_id, line_id, greatest(CAST(round_even(48.0::DOUBLE * greatest(ar, 1 / ar), 0) AS INTEGER), 2) AS strip FROM lines),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY strip, line_id) - 1 AS INTEGER) AS place FROM s) SELECT page_id, line_id, strip, place, place // 16 AS batch, max(strip) OVER (PARTITION BY page_id, place // 16) + 7 AS padded FROM o""")
def ocr_width_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    strip = F.greatest(F.bround(F.greatest(F.col("ar"), 1 / F.col("ar")) * 48.0).cast("int"), F.lit(2))
    rows = lines(spark, sf_dir).select("page_id", "line_id", strip.alias("strip"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("strip", "line_id")) - 1)
    rows = rows.withColumn("batch", F.floor(F.col("place") / 16).cast("int"))
    return rows.withColumn("padded", F.max("strip").over(Window.partitionBy("page_id", "batch")) + 7)


_BOXES = f"""{_MAJORITY}, t AS ({_TEXTS}), big AS (SELECT *, row_number() OVER (PARTITION BY page_id, comp ORDER BY area DESC, line_id) AS r, sum(area) OVER (PARTITION BY page_id) AS pa FROM m),
b AS (SELECT page_id, comp, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS width, max(y + h) - min(y) AS height, round(avg(deg) - 90, 6) AS off, min(fs) AS font_size,
list_transform([1, 2, 3], lambda i: CAST(round_even(list_avg(list_transform(list(fg), lambda c: c[i])), 0) AS INTEGER)) AS fg, list_transform([1, 2, 3], lambda i: CAST(round_even(list_avg(list_transform(list(bg), lambda c: c[i])), 0) AS INTEGER)) AS bg,
max(CASE WHEN r = 1 AND ar < 1 THEN 'v' WHEN r = 1 THEN 'h' END) AS direction, round(exp(sum(ln(prob) * area) / any_value(pa)), 6) AS confidence FROM big GROUP BY 1, 2)"""
_DOCUMENT = """to_json({'page_id': o_orderkey, 'regions': coalesce(list({'text': text, 'x': x, 'y': y, 'width': width, 'height': height, 'angle': CASE WHEN abs(off) < 3 THEN 0.0::DOUBLE ELSE off END, 'font_size': font_size, 'fg': fg, 'bg': bg,
'direction': direction, 'alignment': 'left', 'confidence': confidence, 'line_spacing': 1.0::DOUBLE, 'letter_spacing': 1.0::DOUBLE} ORDER BY comp) FILTER (comp IS NOT NULL), [])})"""


@query(f"WITH RECURSIVE {MERGED}, {_BOXES} SELECT o_orderkey AS page_id, CAST(count(comp) AS INTEGER) AS n_regions, sha256(CAST({_DOCUMENT} AS VARCHAR)) AS digest FROM orders LEFT JOIN (SELECT * FROM b JOIN t USING (page_id, comp)) ON o_orderkey = page_id GROUP BY o_orderkey")
def result_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"))
    return regions.documents(dealt_lines(spark, sf_dir, pages), MERGE_TEST).select("page_id", "n_regions", F.sha2("document", 256).alias("digest"))


@query("SELECT o_orderkey AS page_id, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def empty_images_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id")).join(counts, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0)).alias("n_lines"))


@query(f"WITH b AS (SELECT page_id, regexp_replace({_NAME}, '\\.[^.]*$', '') AS base FROM pages) SELECT page_id, base, count(*) OVER (PARTITION BY base) AS same FROM b")
def output_name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.regexp_replace(text.file_name(F.col("url")), "\\.[^.]*$", "")
    rows = table(spark, sf_dir, "pages").select("page_id", base.alias("base"))
    return rows.join(rows.groupBy("base").agg(F.count("*").alias("same")), "base")


_ESCAPED = r"""replace(replace(replace(replace(replace({}, '\', '\\'), '"', '\"'), chr(10), '\r'), chr(13), '\r'), chr(9), '\t')"""


@query(f"SELECT doc_id, sha256({_ESCAPED.format('text')}) AS digest FROM documents")
def js_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.js_escape(F.col("text")), 256).alias("digest"))


@query(r"SELECT doc_id, 'Text ' || (doc_id + 1) || ': ' || regexp_replace(replace(left(text, 20), chr(10), ' '), '[^\x00-\x7F]', '?', 'g') AS name FROM documents")
def layer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.layer_name(F.col("doc_id") + 1, F.col("text")).alias("name"))


# the fixed parts of a page's script, around the rows of its layers
_PROBE = layered.script([dict(text="?", font_size=10, x=0, y=0, direction="h", fg_color=[0, 0, 0])])
_HEAD, _TAIL = (part.replace("'", "''") for part in re.split(r"  \{.*\}", _PROBE, maxsplit=1))


@query(f"""WITH RECURSIVE {MERGED}, {_BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY comp) AS i, greatest(font_size, 10) AS size FROM b JOIN t USING (page_id, comp)),
l AS (SELECT page_id, i, '  {{"name": "Text ' || i || ': ' || left(text, 20) || '", "text": "' || text || '", "size": ' || size || ', "x": ' || x || ', "y": ' || (y + size * 4 // 5) || ', "vertical": ' || CASE WHEN direction = 'v' THEN 'true' ELSE 'false' END || ', "color": [' || fg[1] || ', ' || fg[2] || ', ' || fg[3] || ']}}' AS layer FROM r)
SELECT page_id, sha256('{_HEAD}' || string_agg(layer, ',' || chr(10) ORDER BY i) || '{_TAIL}') AS digest FROM l GROUP BY 1""")
def jsx_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script of each page, with a layer for each region."""

    @F.pandas_udf("string")
    def script(pages: pd.Series) -> pd.Series:
        return pages.map(lambda found: layered.script([dict(r) for r in json.loads(found)]))

    found = regions.listed(dealt_lines(spark, sf_dir), MERGE_TEST, ["text", "font_size", "x", "y", "direction", "fg"])
    found = found.select("page_id", F.to_json(F.transform("regions", lambda r: r.withField("fg_color", r["fg"]).dropFields("fg"))).alias("regions"))
    return found.select("page_id", F.sha2(script("regions"), 256).alias("digest"))


_VALUABLE = f"regexp_replace(text, '{text.NOT_VALUABLE}', '', 'g')"


@query(f"SELECT doc_id, CAST(length({_VALUABLE}) AS INTEGER) AS n_valuable, length({_VALUABLE}) > 0 AS any_valuable FROM documents")
def valuable_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(text.valuable(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n_valuable"), (n > 0).alias("any_valuable"))


@query(f"SELECT doc_id, lang, regexp_matches(coalesce(text, ''), '{text.RTL}') AS rtl, CASE WHEN lang = 'ko' THEN true WHEN coalesce(lang, '') <> '' THEN false ELSE regexp_matches(coalesce(text, ''), '{text.HANGUL}') END AS korean FROM documents")
def script_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", t.rlike(text.RTL).alias("rtl"), text.is_korean(t, F.col("lang")).alias("korean"))


@query("SELECT conv_id, turn, sha256(CASE WHEN role = 'user' AND regexp_matches(text, '\\S') THEN regexp_replace(text, ' +', ' ', 'g') ELSE text END) AS digest, trim(text) = '' AS blank FROM conversations")
def spacing_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users count as Korean; the corrector at hand joins spaces."""
    lang = F.when(F.col("role") == "user", "ko").otherwise("en")
    fixed = text.corrected(F.col("text"), lang, lambda t, _: F.regexp_replace(t, " +", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(text.shown(fixed, F.col("text")), 256).alias("digest"), (F.trim("text") == "").alias("blank"))


@query("SELECT doc_id, CAST(greatest(ceil(length(text) / 40), 1) AS INTEGER) AS n_lines, sha256(list_aggregate(list_transform(range(CAST(greatest(ceil(length(text) / 40), 1) AS INTEGER)), lambda i: substr(text, i * 40 + 1, 40)), 'string_agg', chr(10))) AS digest FROM documents")
def text_wrap_mono(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = text.wrapped(F.col("text"), 40)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(wrapped).alias("n_lines"), F.sha2(F.array_join(wrapped, "\n"), 256).alias("digest"))


@query(f"WITH {LOGITS}, t AS (SELECT *, row_number() OVER (PARTITION BY vec_id, step ORDER BY lg DESC, tok) AS r FROM logits), s AS (SELECT *, min(CASE WHEN tok = 2 THEN step END) OVER (PARTITION BY vec_id) AS stop FROM t WHERE r = 1) SELECT vec_id, coalesce(string_agg(CASE WHEN tok = 3 THEN ' ' ELSE chr(tok + 97) END, '' ORDER BY step) FILTER (tok <> 1 AND (stop IS NULL OR step < stop)), '') AS text FROM s GROUP BY 1")
def detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = [(i, {1: beam.START_ENTRY, 2: beam.END_ENTRY, 3: beam.SPACE_ENTRY}.get(i, chr(97 + i))) for i in range(16)]
    return beam.detokenised(beam.top_tokens(logits(spark, sf_dir), 1), spark.createDataFrame(entries, "tok int, char string"))


@query(f"WITH {PIXELS} SELECT vec_id, count(*) FILTER (p > 127) AS n_over, CAST(sum(p) FILTER (p > 127) AS BIGINT) AS sum_over, round(avg(p), 6) AS mean_p FROM pixels GROUP BY 1")
def threshold_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.segmented(pixels(spark, sf_dir))


_BLOBS = f"""{PIXELS}, s AS (SELECT vec_id, py, px, py * 8 + px AS i FROM pixels WHERE p > 127),
n AS (SELECT a.vec_id, a.i, b.i AS j FROM s a JOIN s b ON a.vec_id = b.vec_id AND abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1),
r(vec_id, i, j) AS (SELECT vec_id, i, i FROM s UNION SELECT r.vec_id, r.i, n.j FROM r JOIN n ON r.vec_id = n.vec_id AND r.j = n.i), c AS (SELECT vec_id, i, min(j) AS comp FROM r GROUP BY 1, 2),
blobs AS (SELECT vec_id, comp, count(*) AS area, min(i % 8) AS x, min(i // 8) AS y, max(i % 8) - min(i % 8) + 1 AS width, max(i // 8) - min(i // 8) + 1 AS height FROM c GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_BLOBS} SELECT * FROM blobs WHERE area > 9")
def pixel_component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.pixel_components(pixels(spark, sf_dir)).where("area > 9")


@query(f"""WITH RECURSIVE {_BLOBS}, b AS (SELECT vec_id, k AS line_id, (k % 2) * 2 AS bx, (k // 2) * 3 AS by_, 6 AS bw, 5 AS bh FROM (SELECT DISTINCT vec_id FROM pixels), range(4) t(k)),
j AS (SELECT *, greatest(0, least(x + width, bx + bw) - greatest(x, bx)) * greatest(0, least(y + height, by_ + bh) - greatest(y, by_)) / least(area, bw * bh) AS share, sqrt(greatest(0, bx - x - width / 2, x + width / 2 - bx - bw) ** 2 + greatest(0, by_ - y - height / 2, y + height / 2 - by_ - bh) ** 2) AS far FROM blobs JOIN b USING (vec_id) WHERE area > 9),
o AS (SELECT *, row_number() OVER (PARTITION BY vec_id, comp ORDER BY share DESC, line_id) AS r1, row_number() OVER (PARTITION BY vec_id, comp ORDER BY far, line_id) AS r2 FROM j)
SELECT vec_id, comp, CAST(CASE WHEN max(CASE WHEN r1 = 1 THEN area >= bw * bh END) THEN NULL WHEN max(share) > 0.01 THEN max(CASE WHEN r1 = 1 THEN line_id END) ELSE max(CASE WHEN r2 = 1 AND far < 0.5 * greatest(least(bw, bh, width, height), 10) THEN line_id END) END AS INTEGER) AS line_id FROM o GROUP BY 1, 2""")
def component_line_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = pixels(spark, sf_dir)
    k = F.col("line_id")
    boxes = cells.select("vec_id").distinct().withColumn("line_id", F.explode(F.sequence(F.lit(0), F.lit(3))))
    boxes = boxes.select("vec_id", "line_id", ((k % 2) * 2).alias("x"), (F.floor(k / 2) * 3).alias("y"), F.lit(6).alias("w"), F.lit(5).alias("h"))
    return raster.assigned(raster.pixel_components(cells), boxes)


@query(f"WITH {PIXELS} SELECT vec_id, py // 4 AS by, px // 4 AS bx, round(sum(p) / (count(*) * 255), 9) AS score, sum(p) >= count(*) * 255 * 0.5 AS kept FROM pixels GROUP BY 1, 2, 3")
def box_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.box_scores(pixels(spark, sf_dir))


@query(f"WITH {PIXELS} SELECT a.vec_id, CAST(sum(CASE WHEN a.p > 127 THEN b.p ELSE a.p END) AS BIGINT) AS total, count(*) FILTER (a.p > 127) AS masked FROM pixels a JOIN pixels b ON b.vec_id = (a.vec_id + 1) % (SELECT count(DISTINCT vec_id) FROM pixels) AND a.py = b.py AND a.px = b.px GROUP BY 1")
def mask_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.composite(pixels(spark, sf_dir))


@query(f"WITH {LOGITS}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id, step ORDER BY lg DESC, tok) AS INTEGER) AS rank FROM logits) SELECT vec_id, step, tok, lg, rank FROM t WHERE rank <= 5")
def beam_topk_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beam.top_tokens(logits(spark, sf_dir)).select("vec_id", "step", "tok", "lg", "rank")


def _beam_sql(k: int = 5, steps: int = 4) -> str:
    """The steps of the search, one table each: b0 holds the first tokens, c the beams with how many have ended, o what they
    grow into."""
    parts = [f"t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, step ORDER BY lg DESC, tok) AS r FROM logits) WHERE r <= {k})"]
    parts.append(f"b0 AS (SELECT vec_id, r - 1 AS i, [tok] AS toks, lg AS score, tok = {beam.END} AS ended FROM t WHERE step = 0)")
    for n in range(1, steps):
        parts += [
            f"c{n} AS (SELECT *, count(*) FILTER (ended) OVER (PARTITION BY vec_id) AS done FROM b{n - 1})",
            f"g{n} AS (SELECT c.vec_id, c.i, t.r, list_append(c.toks, CASE WHEN c.ended THEN {beam.END} ELSE t.tok END) AS toks, c.score + CASE WHEN c.ended THEN 0 ELSE t.lg END AS score, c.ended OR t.tok = {beam.END} AS ended FROM c{n} c JOIN t ON c.vec_id = t.vec_id AND t.step = {n} WHERE c.done < {beam.FINISHED})",
            f"o{n} AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i, r) - 1 AS n FROM g{n})",
            f"b{n} AS (SELECT vec_id, n AS i, toks, score, ended FROM o{n} WHERE n < {k} UNION ALL SELECT vec_id, i, toks, score, ended FROM c{n} WHERE done >= {beam.FINISHED})",
        ]
    return f"WITH {LOGITS}, {', '.join(parts)} SELECT vec_id, array_to_string(toks, ' ') AS tokens, score, ended FROM b{steps - 1} WHERE i = 0"


@query(_beam_sql())
def beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return beam.search(logits(spark, sf_dir))


# a token's colours are those 16 and 32 components on; its flags compare it with the next two
_TOKENS = """c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, unnest(range(64)) AS i FROM embeddings),
t AS (SELECT vec_id, e[i + 1] > e[(i + 1) % 64 + 1] AS has_fg, e[i + 1] > e[(i + 2) % 64 + 1] AS has_bg, list_transform([0, 16, 32], lambda k: trunc((e[(i + k) % 64 + 1] + 1) / 2 * 255)) AS fg, list_transform([0, 16, 32], lambda k: trunc((e[(i + k + 1) % 64 + 1] + 1) / 2 * 255)) AS bg FROM c)"""
_FOLDED = ", ".join(f"CAST(greatest(0, least(255, trunc(coalesce(avg({x}), 0)))) AS INTEGER) AS {c}_{n}" for c, of in (("fg", "CASE WHEN has_fg THEN fg[{0}] END"), ("bg", "CASE WHEN has_bg THEN bg[{0}] ELSE fg[{0}] END")) for i, n in enumerate("rgb", 1) for x in [of.format(i)])


@query(f"WITH {_TOKENS} SELECT vec_id, {_FOLDED} FROM t GROUP BY 1")
def color_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"), F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("i"))
    at = lambda k: F.get("e", (F.col("i") + k) % F.size("e"))
    colour = lambda first: F.array(*[(at(first + k) + 1) / 2 for k in (0, 16, 32)])
    tokens = rows.select("vec_id", colour(0).alias("fg"), colour(1).alias("bg"), (at(0) > at(1)).alias("has_fg"), (at(0) > at(2)).alias("has_bg"))
    return beam.folded_colours(tokens).select("vec_id", *[F.col(c)[i].alias(f"{c}_{n}") for c in ("fg", "bg") for i, n in enumerate("rgb")])


@query(f"WITH {LINES} SELECT page_id, line_id, round((y - cy) * sin(radians(deg - 90)) + (x - cx) * cos(radians(deg - 90)) + cx, 4) AS rx, round((y - cy) * cos(radians(deg - 90)) - (x - cx) * sin(radians(deg - 90)) + cy, 4) AS ry FROM lines")
def rotated_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    rx, ry = geometry.rotated(*[F.col(c) for c in ("x", "y", "cx", "cy")], F.col("deg") - 90)
    return lines(spark, sf_dir).select("page_id", "line_id", F.round(rx, 4).alias("rx"), F.round(ry, 4).alias("ry"))


@query(f"""WITH {LINES}, t AS (SELECT *, least(1, greatest(0, ((cy - y) * h + cx - 3 - x) / (h * h + 1))) AS pos FROM (SELECT *, CAST(h AS DOUBLE) AS hh FROM lines))
SELECT page_id, line_id, round(sqrt((cx - 3 - x - pos) ** 2 + (cy - y - pos * hh) ** 2), 6) AS far FROM t""")
def point_segment_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = geometry.segment_distance(F.col("cx") - 3, F.col("cy"), F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + F.col("h"))
    return lines(spark, sf_dir).select("page_id", "line_id", F.round(far, 6).alias("far"))


@query(f"WITH {LINES} SELECT page_id, line_id, greatest(x - fs, 0) AS x1, least(w + fs * 2, 300 - greatest(x - fs, 0) - 1) AS w1, greatest(y - fs, 0) AS y1, least(h + fs * 2, 300 - greatest(y - fs, 0) - 1) AS h1 FROM lines")
def extended_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, w = geometry.extended(F.col("x"), F.col("w"), F.lit(300), F.col("fs"))
    y, h = geometry.extended(F.col("y"), F.col("h"), F.lit(300), F.col("fs"))
    return lines(spark, sf_dir).select("page_id", "line_id", x.alias("x1"), w.alias("w1"), y.alias("y1"), h.alias("h1"))


@query("WITH s AS (SELECT page_id, greatest(coalesce(length(html), 0), coalesce(length(url), 0)) AS long, least(coalesce(length(html), 0), coalesce(length(url), 0)) AS short FROM pages) SELECT page_id, coalesce(long > 2.5 * 256 AND long / nullif(short, 0) > 3, false) AS tiles FROM s")
def tiling_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = [F.coalesce(F.length(c), F.lit(0)) for c in ("url", "html")]
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(geometry.needs_tiles(*sides, 256), F.lit(False)).alias("tiles"))


@query(f"WITH RECURSIVE {MERGED}, t AS (SELECT *, row_number() OVER (PARTITION BY page_id, comp ORDER BY area DESC, line_id) AS r FROM m) SELECT page_id, comp, CASE WHEN count(*) = 1 OR max(CASE WHEN r = 1 AND ar >= 1 THEN 1 ELSE 0 END) = 1 THEN 'center' ELSE 'left' END AS alignment FROM t GROUP BY 1, 2")
def region_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions.of_linked(dealt_lines(spark, sf_dir), MERGE_TEST, ["n_lines", "direction"])
    return rows.select(*regions.KEYS, geometry.alignment(F.col("n_lines"), F.col("direction")).alias("alignment"))


@query(f"WITH {QUADS} SELECT page_id, line_id, vertical, round(ratio, 6) AS ratio, round(fs, 6) AS fs, round(angle, 6) AS angle, upright, area, x, y, w, h FROM quads")
def quad_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quads.all_measures(dealt_lines(spark, sf_dir).select(*derived.TURNED), derived.turned)
    return rows.select("page_id", "line_id", "vertical", F.round("ratio", 6).alias("ratio"), F.round("fs", 6).alias("fs"), F.round("angle", 6).alias("angle"), "upright", "area", "x", "y", "w", "h")


# distances of the quads whose boxes are near: no axis keeps them apart, else the least way from a corner to a side
_QUAD_GAPS = f"""{QUADS}, near AS (SELECT a.page_id, a.line_id AS u, b.line_id AS v, least(a.fs, b.fs) AS fs, greatest(a.fs, b.fs) AS fs2, a.ratio AS ar1, b.ratio AS ar2, a.angle AS t1, b.angle AS t2, a.upright AND b.upright AS up,
a.px AS ax, a.py AS ay, b.px AS bx, b.py AS by_, a.x AS x1, a.y AS y1, a.w AS w1, a.h AS h1, b.x AS x2, b.y AS y2, b.w AS w2, b.h AS h2 FROM quads a JOIN quads b ON a.page_id = b.page_id AND a.line_id < b.line_id WHERE {_GAP} <= 2 * least(a.fs, b.fs)),
ends AS (SELECT page_id, u, v, ax AS px, ay AS py, bx AS qx, by_ AS qy FROM near UNION ALL SELECT page_id, u, v, bx, by_, ax, ay FROM near),
axes AS (SELECT page_id, u, v, px, py, qx, qy, py[i % 4 + 1] - py[i] AS nx, px[i] - px[i % 4 + 1] AS ny FROM ends, range(1, 5) r(i)),
shades AS (SELECT page_id, u, v, list_transform([1, 2, 3, 4], lambda k: px[k] * nx + py[k] * ny) AS s, list_transform([1, 2, 3, 4], lambda k: qx[k] * nx + qy[k] * ny) AS t FROM axes),
apart AS (SELECT page_id, u, v, bool_or(list_max(s) < list_min(t) OR list_max(t) < list_min(s)) AS apart FROM shades GROUP BY 1, 2, 3),
off AS (SELECT page_id, u, v, px[k] - qx[i] AS x, py[k] - qy[i] AS y, CAST(qx[i % 4 + 1] - qx[i] AS DOUBLE) AS rx, CAST(qy[i % 4 + 1] - qy[i] AS DOUBLE) AS ry FROM ends, range(1, 5) r(i), range(1, 5) c(k)),
put AS (SELECT *, least(1, greatest(0, (x * rx + y * ry) / (rx * rx + ry * ry))) AS t FROM off),
ways AS (SELECT page_id, u, v, min(sqrt((x - t * rx) ** 2 + (y - t * ry) ** 2)) AS way FROM put GROUP BY 1, 2, 3),
gaps AS (SELECT near.*, CASE WHEN apart THEN way ELSE 0 END AS gap FROM near JOIN apart USING (page_id, u, v) JOIN ways USING (page_id, u, v))"""


@query(f"WITH {_QUAD_GAPS} SELECT page_id, u, v, round(gap, 6) AS gap FROM gaps WHERE gap <= 2 * fs")
def quad_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads.near_pairs(dealt_lines(spark, sf_dir).select(*derived.TURNED), derived.turned, 2).select("page_id", "u", "v", F.round("gap", 6).alias("gap"))


@query(f"""WITH {_QUAD_GAPS} SELECT page_id, u, v FROM gaps WHERE CASE WHEN up THEN {_edge_sql(pairs.MERGE)}
ELSE {_near_sql(pairs.MERGE)} AND abs(t1 - t2) < radians(15) AND gap <= fs * {pairs.MERGE.edge} AND (fs2 - fs) / fs <= 0.25 END""")
def quad_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quads.merged(dealt_lines(spark, sf_dir).select(*derived.TURNED), derived.turned, pairs.MERGE)


@query(f"""WITH {LINES}, p AS (SELECT page_id, line_id, cx, cy, deg - 90 AS angle, x AS px, y AS py FROM lines UNION ALL SELECT page_id, line_id, cx, cy, deg - 90, x + w, y + h FROM lines),
f AS (SELECT *, round((py - cy) * sin(radians(angle)) + (px - cx) * cos(radians(angle)) + cx, 9) AS fx, round((py - cy) * cos(radians(angle)) - (px - cx) * sin(radians(angle)) + cy, 9) AS fy FROM p),
b AS (SELECT page_id, line_id, cx, cy, -any_value(angle) AS back, min(fx) AS l, max(fx) AS r, min(fy) AS t, max(fy) AS b FROM f GROUP BY 1, 2, 3, 4)
SELECT page_id, line_id, greatest(0, CAST(trunc(round((t - cy) * sin(radians(back)) + (l - cx) * cos(radians(back)) + cx, 6)) AS INTEGER)) AS x1, greatest(0, CAST(trunc(round((b - cy) * cos(radians(back)) - (r - cx) * sin(radians(back)) + cy, 6)) AS INTEGER)) AS y3 FROM b""")
def region_min_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("angle", F.col("deg") - 90)
    ends = [rows.select("page_id", "line_id", "cx", "cy", "angle", x.alias("x"), y.alias("y")) for x, y in ((F.col("x"), F.col("y")), (F.col("x") + F.col("w"), F.col("y") + F.col("h")))]
    found = quads.min_rect(ends[0].unionByName(ends[1]), ["page_id", "line_id"])
    return found.select("page_id", "line_id", F.col("quad")[0].x.alias("x1"), F.col("quad")[2].y.alias("y3"))
