"""Texts beyond what the operators handle at once: whole texts count."""

import hashlib
import random

import pytest

from layertext.llm import fingerprints, interpolation, langid, minhash, mixing, packing, passages, urls, words

r = random.Random(31)
LONG = " ".join(f"Word{r.randrange(30_000)}" for _ in range(260_000))  # over words.PIECE bytes
ROWS = [(1, LONG, "aa", "s"), (2, "Kurz davor\n" + LONG, "aa", "s"), (3, "a b c", "bb", "s"), (4, None, "bb", None), (5, "x" * 3_000_000, "aa", "t")]


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > words.PIECE
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(2).cache()


def test_words_are_counted_whole(docs):
    want = {i: len((t or "").split()) for i, t, *_ in ROWS}
    assert {x.doc_id: x.size for x in mixing.mixture(docs).collect()} == want
    assert {x.doc_id: x.length for x in packing.pack(docs).collect()} == want
    assert {x.doc_id: x.n_tokens for x in interpolation.scores(docs).collect()} == {i: n + 1 for i, n in want.items()}


def test_sets_and_passages_are_whole(docs):
    w = LONG.lower().split()
    found = {x.doc_id: x for x in minhash.near_duplicates(docs).collect()}
    assert found[1].n_shingles == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert found[2].component_id == 1 and found[5].component_id == 5 and found[5].n_shingles == 1
    spans = [(x.doc_id, x.start, x.stop, x.kept_doc_id) for x in passages.repeated_passages(docs).collect()]
    covered = {i for d, a, b, _ in spans for i in range(a, b)}
    assert {d for d, *_ in spans} == {2} and covered == set(range(2, len(w) + 2))
    left = {x.doc_id: x.text for x in passages.without_passages(docs).collect()}
    assert left[2].split() == ["Kurz", "davor"] and left[1] == LONG


def test_fingerprints_and_languages_are_whole(docs):
    found = {x.doc_id: x for x in fingerprints.fingerprints(docs).collect()}
    for (i, t, *_), (_, u, *_) in zip(ROWS, [*ROWS[1:], ROWS[0]], strict=True):
        t, u = t or "", u or ""
        cut = len(t) // 4
        assert found[i].n_chars == len(t) and found[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + u[:cut]).encode()).hexdigest()
        assert 0 <= found[i].near_edited <= 1
    assert {x.doc_id: x.lang_pred for x in langid.identify(docs).collect()}[4] == "und"


def test_long_urls_are_whole(spark):
    path = "/en/" + "a/" * 200_000 + "7"
    rows = [(1, f"http://example.com{path}?q"), (2, "http://" + "h" * 500_000 + "/x")]
    found = {x.page_id: x for x in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert found[1].path == path and found[1].rule == "com/en/" and len(found[2].host) == 500_000
