import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from layertext.llm import langid


def test_codewords_differ():
    for n in (2, 3, 4, 6, 9, 40):
        code = langid.codewords(n)
        assert len({tuple(x) for x in code}) == n
        assert all(abs(code[:, b].sum()) < n for b in range(code.shape[1]))


def test_margins_equal_a_plain_sum():
    odds = np.random.default_rng(1).normal(size=(sum(langid.CELLS), 3)).astype(np.float32)
    texts = ["", "a", "ab", "Hello, WORLD 12", None, "Ärger über ÉTÉ", "x" * 5000]
    whole = langid.margins(pa.array(texts), odds)
    for i, t in enumerate(texts):
        assert np.allclose(langid.margins(pa.array([t], pa.string()), odds)[0], whole[i], rtol=1e-4)
    old, langid.PIECE = langid.PIECE, 1000
    try:
        assert np.allclose(langid.margins(pa.array(texts), odds), whole, rtol=1e-4)
    finally:
        langid.PIECE = old


def test_margins_take_little_memory_beside_the_texts():
    column = pa.array(["Wörter über ÉTÉ und Ähnliches " * 65] * 1000)
    odds = np.random.default_rng(2).normal(size=(sum(langid.CELLS), 7)).astype(np.float32)
    tracemalloc.start()
    try:
        assert langid.has_letter(column).all()
        whole = langid.margins(column, odds)
        assert tracemalloc.get_traced_memory()[1] < 8 * column.nbytes
    finally:
        tracemalloc.stop()
    old, langid.PIECE = langid.PIECE, 7  # pieces that begin within a letter
    try:
        assert np.allclose(langid.margins(column[:1], odds)[0], whole[0], rtol=1e-4)
    finally:
        langid.PIECE = old


def corpus():
    r = random.Random(4)
    parts = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "ver", "ein"], "cc": ["ção", "inho", "lh", "que"]}
    return [(i, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(r.choice([3, 20, 80]))), lang) for i in range(900) for lang in [r.choice(list(parts))]]


def test_accuracy_and_und(spark):
    rows = corpus() + [(5000, None, "aa"), (5001, "", "bb"), (5002, "123 ...", None), (5003, "日本", None), (None, "kato mire", "aa"), (5004, "ka", None), (5004, "ka", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as __x")
    out = langid.identify(df).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [by[i].lang_pred for i in (5000, 5001, 5002)] == ["und"] * 3 and by[5003].lang_pred != "und"
    held = [r for r in out if r.held_out and r.lang]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in out) and not by[None].held_out
    kept = langid.drop_unidentified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[3:] for r in langid.identify(df).collect()] == [(False, "und", 0.0, False, None)]
    assert langid.identify(df.limit(0)).collect() == []


def test_texts_of_noise_are_rejected_and_clean_ones_stay(spark):
    r = random.Random(9)
    rows = corpus() + [(7000 + i, "".join(r.choice("bcdfghjklmnpqrstvwxz") for _ in range(400)), "aa") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {x.doc_id for x in langid.drop_unidentified(df).collect()}
    assert {i for i, _, _ in rows if i < 7000} <= kept
    unlabelled = df.selectExpr("doc_id", "text", "cast(null as string) as lang", "1 as loss")
    assert langid.drop_unidentified(unlabelled).count() == len(rows) and langid.drop_unidentified(unlabelled).columns == unlabelled.columns


def test_a_rare_language_is_learned(spark):
    rows = corpus() + [(8000 + i, "ωψφ ξχθ " * 20, "rare") for i in range(4)]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=50).collect()
    assert {x.lang_pred for x in out if x.doc_id >= 8000} == {"rare"}
    held = [x for x in out if x.held_out]
    assert sum(x.lang == x.lang_pred for x in held) / len(held) > 0.97


def test_the_model_is_shipped_without_the_package():
    import pickle
    import pickletools

    model = langid.Model(["a", "b"], langid.codewords(2), np.zeros((3, 1), np.float32), np.ones(1))
    names = {str(arg) for op, arg, _ in pickletools.genops(pickle.dumps(tuple(model), 2)) if op.name in ("GLOBAL", "STACK_GLOBAL")}
    assert not any("layertext" in n for n in names)


def test_a_batch_holds_the_texts_once_and_any_column_stays(spark):
    rows = corpus()[:300]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("__text", (-F.col("doc_id")).cast("string"))
    out = langid.identify(df)
    assert {(r.doc_id, r.text, r["__text"]) for r in out.collect()} == {(i, t, str(-i)) for i, t, _ in rows}
    as_bytes = df.drop("__text").withColumn("text", F.encode("text", "utf-8"))  # not a string: cast beside it
    assert sorted(r.lang_pred for r in langid.identify(as_bytes).collect()) == sorted(r.lang_pred for r in out.collect())
