"""The queries that apply each operator of this subpackage to its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layertext.llm import fingerprints, interpolation, langid, minhash, mixing, packing, passages, pivots, shared, urls, warc

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A text's words in DuckDB.
SQL_WORDS = rf"coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+'), [])"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shared.result(spark, lambda: minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85), "op3")
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP3_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, c.m AS component_id, n.doc_id = c.m AS kept FROM n JOIN c ON n.doc_id = c.a
"""

def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shared.result(spark, lambda: mixing.mixture(table(spark, sf_dir, "documents")), "op1")
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_pack_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.result(spark, lambda: packing.pack(table(spark, sf_dir, "documents")), "op9")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # fit() is through with its tables when it returns
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.result(spark, lambda: urls.filter_urls(table(spark, sf_dir, "pages")), "op2")


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.result(spark, lambda: warc.round_trip(table(spark, sf_dir, "pages")), "op4")


def op10_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.result(spark, lambda: pivots.top_products(table(spark, sf_dir, "embeddings")), "op10")


def op7_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    return found.withColumns({"n_removed": F.size("removed"), "n_added": F.size("added")}).drop("removed", "added")


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.result(spark, lambda: interpolation.scores(table(spark, sf_dir, "documents")), "op6")


def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared.result(spark, lambda: passages.repeated_passages(table(spark, sf_dir, "documents")).drop("th"), "op5")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_url_templates": op2_url_templates,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_warc_segments": op4_warc_segments,
    "op5_compact_windows": op5_compact_windows,
    "op6_deleted_interpolation": op6_deleted_interpolation,
    "op7_iblt_fingerprints": op7_iblt_fingerprints,
    "op8_language_id": op8_language_id,
    "op9_pack_length_buckets": op9_pack_length_buckets,
    "op10_pivot_top_k": op10_pivot_top_k,
}
ORACLES = {
    "op2_url_templates": urls.sql(),
    "op3_minhash_near_dedup": OP3_SQL,
    "op4_warc_segments": warc.SQL,
    "op10_pivot_top_k": pivots.SQL,
}
