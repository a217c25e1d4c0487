"""The language of a text by its most frequent words; stands for a trained classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words of a language's profile.
WORDS = 100


def _words(docs: DataFrame, *kept: str) -> DataFrame:
    return docs.select(*kept, F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("word"))


def profiles(docs: DataFrame) -> DataFrame:
    """(guess, word): the WORDS most frequent words of the texts of each lang; of equally frequent ones the first."""
    counts = _words(docs.where("lang is not null"), "lang").groupBy("lang", "word").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counts.withColumn("r", place).where(F.col("r") <= WORDS).select(F.col("lang").alias("guess"), "word")


def guessed(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs (doc_id, text) with guess: the language with the most words of the text in its profile, the first of equals, or
    empty.  The profiles are WORDS rows a language and are broadcast."""
    hits = _words(docs, "doc_id").groupBy("doc_id", "word").agg(F.count("*").alias("n")).join(F.broadcast(known), "word")
    best = hits.groupBy("doc_id", "guess").agg(F.sum("n").alias("n")).groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("k"), "guess")).alias("b"))
    return docs.join(best.select("doc_id", "b.guess"), "doc_id", "left").withColumn("guess", F.coalesce("guess", F.lit("")))
