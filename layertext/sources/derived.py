"""Text lines, probability maps and token logits as views of the shared tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from layertext.operators import paged, quads


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The order of the lines of a page.
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def _lines(rows: DataFrame) -> DataFrame:
    """The lines of rows of lineitem, without line_id."""
    tall = F.col("l_suppkey") % 4 == 0
    q = F.col("l_quantity").cast("int")
    wide, thin = 60 + q, 14 + q % 12
    rows = rows.select(
        F.col("l_orderkey").alias("page_id"),
        *[c for c in rows.columns if c in ("line_id", "page")],
        ((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 160).cast("int").alias("x"),
        ((F.col("l_partkey") * 13 + F.col("l_suppkey") * 29) % 240).cast("int").alias("y"),
        F.when(tall, thin).otherwise(wide).alias("w"),
        F.when(tall, wide).otherwise(thin).alias("h"),
        (F.lit(0.2) + F.col("l_discount") * 5).alias("prob"),
        F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("txt"),
        *[F.array(*[(F.col(f"l_{of}key") * k % 256).cast("int") for k in (1, 7, 13)]).alias(name) for name, of in (("fg", "part"), ("bg", "supp"))],
        (F.lit(90) + (F.col("l_discount") - 0.05) * 100).alias("deg"),
    )
    return rows.withColumns(
        {
            "fs": F.least("w", "h"),
            "ar": F.col("w") / F.col("h"),
            "direction": F.when(F.col("w") > F.col("h"), "h").otherwise("v"),
            "area": F.col("w") * F.col("h"),
            "cx": F.col("x") + F.col("w") / 2,
            "cy": F.col("y") + F.col("h") / 2,
        }
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upright text line a lineitem; its page is the order."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)) - 1
    return _lines(table(spark, sf_dir, "lineitem").withColumn("line_id", place))


def dealt_lines(spark: SparkSession, sf_dir: str, pages: DataFrame | None = None) -> DataFrame:
    """lines() dealt out by page and in order, for paged.mapped(); their places are their line_id, so they have none.

    pages: rows of a page_id that come after the lines of each page and have page true; the lines have it false.
    """
    rows = table(spark, sf_dir, "lineitem")
    if pages is None:
        return _lines(paged.dealt(rows, ["l_orderkey"], *_ORDER))
    both = rows.withColumn("page", F.lit(False)).unionByName(pages.select(F.col("page_id").alias("l_orderkey"), F.lit(True).alias("page")), allowMissingColumns=True)
    return _lines(paged.dealt(both, ["l_orderkey"], "page", *_ORDER))


LINES = """lines AS (SELECT *, least(w, h) AS fs, w / h AS ar, CASE WHEN w > h THEN 'h' ELSE 'v' END AS direction, w * h AS area, x + w / 2 AS cx, y + h / 2 AS cy FROM (
SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS line_id,
CAST((l_partkey * 37 + l_suppkey * 11) % 160 AS INTEGER) AS x, CAST((l_partkey * 13 + l_suppkey * 29) % 240 AS INTEGER) AS y,
CASE WHEN l_suppkey % 4 = 0 THEN 14 + CAST(l_quantity AS INTEGER) % 12 ELSE 60 + CAST(l_quantity AS INTEGER) END AS w,
CASE WHEN l_suppkey % 4 = 0 THEN 60 + CAST(l_quantity AS INTEGER) ELSE 14 + CAST(l_quantity AS INTEGER) % 12 END AS h,
0.2::DOUBLE + l_discount * 5 AS prob, 'T' || l_partkey AS txt, [CAST(l_partkey * k % 256 AS INTEGER) FOR k IN [1, 7, 13]] AS fg, [CAST(l_suppkey * k % 256 AS INTEGER) FOR k IN [1, 7, 13]] AS bg, 90 + (l_discount - 0.05::DOUBLE) * 100 AS deg FROM lineitem))"""


#: What turned() looks at.
TURNED = ("page_id", "x", "y", "w", "h", "cx", "cy", "deg")


def turned(pages: paged.Pages) -> quads.Measures:
    """The lines turned about their centres by deg - 90, as quads whose corners start anywhere, measured."""
    x, y, w, h, cx, cy, deg = (paged.numbers(pages.table, c) for c in TURNED[1:])
    a = np.radians(deg - 90)
    sin, cos = np.sin(a)[:, None], np.cos(a)[:, None]
    dx, dy = np.stack([x, x + w, x + w, x], axis=1) - cx[:, None], np.stack([y, y, y + h, y + h], axis=1) - cy[:, None]
    corners = np.stack([dy * sin + dx * cos + cx[:, None], dy * cos - dx * sin + cy[:, None]], axis=2)
    corners = np.floor(np.round(corners, 6) + 0.5)
    start = (pages.ids() % 4)[:, None] + np.arange(4)
    return quads.measures(np.take_along_axis(corners, (start % 4)[..., None], axis=1))


_TURNED = "list_transform([[x, y], [x + w, y], [x + w, y + h], [x, y + h]], lambda c: CAST(floor(round({}, 6) + 0.5) AS INTEGER))"
_SIN, _COS = "sin(radians(deg - 90))", "cos(radians(deg - 90))"
#: The measures of the quads; corners from the top left on, which turning by 5 degrees at most leaves in their order.
QUADS = f"""{LINES}, q AS (SELECT page_id, line_id, h > w AS vertical, {_TURNED.format(f"(c[2] - cy) * {_SIN} + (c[1] - cx) * {_COS} + cx")} AS px, {_TURNED.format(f"(c[2] - cy) * {_COS} - (c[1] - cx) * {_SIN} + cy")} AS py FROM lines),
mid AS (SELECT *, trunc((px[3] + px[4]) / 2) - trunc((px[1] + px[2]) / 2) AS dx, trunc((py[3] + py[4]) / 2) - trunc((py[1] + py[2]) / 2) AS dy, trunc((px[4] + px[1]) / 2) - trunc((px[2] + px[3]) / 2) AS ox, trunc((py[4] + py[1]) / 2) - trunc((py[2] + py[3]) / 2) AS oy FROM q),
len AS (SELECT *, sqrt(dx * dx + dy * dy) AS dl, sqrt(ox * ox + oy * oy) AS ol FROM mid),
quads AS (SELECT *, ol / dl AS ratio, least(ol, dl) AS fs, acos(dx / dl) % pi() AS angle, least(abs(dx) / dl, abs(dy) / dl, abs(ox) / ol, abs(oy) / ol) < 0.05 AS upright,
abs(px[1] * py[2] - px[2] * py[1] + px[2] * py[3] - px[3] * py[2] + px[3] * py[4] - px[4] * py[3] + px[4] * py[1] - px[1] * py[4]) / 2 AS area,
list_min(px) AS x, list_min(py) AS y, list_max(px) - list_min(px) AS w, list_max(py) - list_min(py) AS h FROM len)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 maps of probabilities as 0..255 from the embeddings."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    p = F.floor(255 / (1 + F.exp(-10 * F.col("e").cast("double")))).cast("int")
    return cells.select("vec_id", F.floor(F.col("i") / 8).cast("int").alias("py"), (F.col("i") % 8).alias("px"), p.alias("p"))


PIXELS = """pixels AS (SELECT vec_id, CAST(i // 8 AS INTEGER) AS py, CAST(i % 8 AS INTEGER) AS px, CAST(floor(255 / (1 + exp(-10 * CAST(embedding[i + 1] AS DOUBLE)))) AS INTEGER) AS p
FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings))"""


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 steps of 16 token scores from the embeddings, as exact integers."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    score = F.round(F.col("e").cast("double") * 1_000_000).cast("long")
    return cells.select("vec_id", F.floor(F.col("i") / 16).cast("int").alias("step"), (F.col("i") % 16).alias("tok"), score.alias("lg"))


LOGITS = """logits AS (SELECT vec_id, CAST(i // 16 AS INTEGER) AS step, CAST(i % 16 AS INTEGER) AS tok, CAST(round(CAST(embedding[i + 1] AS DOUBLE) * 1000000) AS BIGINT) AS lg
FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings))"""
