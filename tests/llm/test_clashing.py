"""Extra columns whose names the operators use themselves, and nulls in every column: the results stay the same."""

import pytest
from pyspark.sql import functions as F

from layertext.llm import fingerprints, interpolation, langid, minhash, mixing, packing, passages, pivots, urls, warc

NAMES = (
    "a b bits bucket c chunk class comp component_id count cell d digest doc end fold h hash held_out host i id iblt idx k kept key lang_pred last length m map n n_chars n_shingles "
    "n_tokens node number p page part path payload pid pivot pos q query_id rank ratio refers root row rule score seg sig size sketch source_size start t taken target template th "
    "total u v vec verdict w weight width words x __at __id __n __salt __th"
).split()

LONG = " ".join(f"w{i}" for i in range(70))


def docs(spark):
    rows = [(1, f"a {LONG} b", "en", "s"), (2, f"c {LONG} d", "de", None), (3, None, None, "s"), (None, "alone here", "en", "t"), (4, "", "de", "t"), (5, "ein Wort", None, None), (5, "ein Wort", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def pages(spark):
    rows = [(1, "http://a.com/en/1", "x" * 1200), (2, None, "x" * 1200), (3, "none", None), (None, "http://b.org/es/2", ""), (4, "http://c.net/q", "short"), (4, "http://c.net/q", "short")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def vectors(spark):
    rows = [(i, [i % 3 / 4.0, 0.5, -0.25]) for i in range(60)] + [(100, None), (None, [1.0, 1.0, 1.0]), (101, [None, 1.0, 1.0]), (150, [])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


CASES = {
    "mixing": (docs, mixing.mixture),
    "mixed": (docs, lambda d: mixing.mix(d).select("doc_id", "text")),
    "urls": (pages, urls.filter_urls),
    "minhash": (docs, lambda d: minhash.near_duplicates(d, percent=85)),
    "unique": (docs, lambda d: minhash.drop_near_duplicates(d).select("doc_id", "text")),
    "warc": (pages, warc.round_trip),
    "passages": (docs, passages.repeated_passages),
    "cut": (docs, lambda d: passages.without_passages(d).select("doc_id", "text")),
    "interpolation": (docs, interpolation.scores),
    "fingerprints": (docs, fingerprints.fingerprints),
    "langid": (docs, lambda d: langid.identify(d, mod=4).select("doc_id", "lang_pred", "score")),
    "identified": (docs, lambda d: langid.drop_unidentified(d).select("doc_id", "text")),
    "packing": (docs, packing.pack),
    "pivots": (vectors, pivots.top_products),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_clashing_names(spark, name):
    table, operator = CASES[name]
    plain = table(spark)
    crowded = plain.withColumns({c: F.lit(None).cast("string") if i % 2 else F.lit(i) for i, c in enumerate(NAMES) if c not in plain.columns})
    want, got = operator(plain), operator(crowded)
    columns = want.columns
    rows = [sorted(repr([r[c] for c in columns]) for r in df.collect()) for df in (want, got)]
    assert rows[0] and rows[0] == rows[1]
