"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1.  For each bit a binary classifier, naive Bayes over byte n-grams, gives a
margin; the language whose codeword loses least against the margins, each bit weighted by how well it did on rows kept
back from fitting, is chosen.  A small lead over the second language flags the text as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layertext.llm import shared, words

#: Cells of the n-grams of 1, 2 and 3 bytes.
CELLS = (256, 1 << 14, 1 << 15)
#: Labelled rows of each language that the classifiers are fitted on, about: a sample by the hash of doc_id.  Every fifth
#: sets the weights.
SAMPLE = 2_500
#: A text is rejected whose language loses, for each bit, at least what a margin of 0 does.
CHANCE = float(np.log(2))
#: Bytes handled at once; for each of them a row of log odds is looked up, 4 bytes a bit.
PIECE = 1 << 16

_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[65:91] += 32
_BLANK[[*range(65), *range(91, 97), *range(123, 128)]] = 32


#: The columns that identify() adds.
NEW = ["held_out", "lang_pred", "score", "ambiguous", "loss"]


class Model(NamedTuple):
    """langs, codewords [language, bit], log odds [cell, bit] and weights [bit]."""

    langs: list[str]
    code: np.ndarray
    odds: np.ndarray
    weight: np.ndarray


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """All ways to split up to 6 languages, else random splits, 10 for each doubling of the languages."""
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 6:
        bits = [[1 if x >> i & 1 else -1 for i in range(n)] for x in range(1, 2 ** (n - 1))]
        return np.array(bits, np.float32).T
    rng, bits = np.random.default_rng(seed), []
    while len(bits) < 10 * int(np.ceil(np.log2(n))):
        bit = rng.permutation(np.r_[np.ones(n // 2), -np.ones(n - n // 2)])
        bits.append(bit)
    return np.array(bits, np.float32).T


def _grams(buf: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last text, cells, text of each cell in order) of one size of n-grams for pieces of whole texts; long texts
    come in several pieces."""
    at = 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + PIECE, "right")) - 1)
        for low in range(int(bounds[at]), max(int(bounds[to]), int(bounds[at]) + 1), PIECE):
            high = min(int(bounds[to]), low + PIECE)
            end = min(int(bounds[to]), high + 2)
            x = buf[low:end].copy()
            before = np.r_[buf[low - 1 : low], x[:-1]] if low else np.r_[np.zeros(min(1, len(x)), np.uint8), x[:-1]]
            x[(before == 0xC3) & (x >= 0x80) & (x <= 0x9E)] += 32  # capital letters of the second block of two bytes
            y = _BLANK[x].astype(np.uint32)
            owner = np.repeat(np.arange(at, to), np.diff(bounds[at : to + 1])) if to > at + 1 else np.full(len(y), at)
            n = high - low
            yield at, to, y[:n], owner[:n]
            code, base = y, CELLS[0]
            for size in (2, 3):
                code = code[:-1] * np.uint32(0x01000193) + y[size - 1 :] + np.uint32(size)
                m = min(n, len(code))
                if m <= 0:
                    break
                inside = owner[:m] == owner[size - 1 : m + size - 1]
                mixed = (code[:m] * np.uint32(0x9E3779B1)) >> np.uint32(32 - (CELLS[size - 1].bit_length() - 1))
                yield at, to, mixed[inside] + np.uint32(base), owner[:m][inside]
                base += CELLS[size - 1]
        at = to


def margins(column: pa.Array, odds: np.ndarray) -> np.ndarray:
    """[text, bit]: the sum of the log odds of a text's n-grams over the root of their number."""
    buf, bounds = words.text_buffer(column)
    total = np.zeros((len(column), odds.shape[1]))
    count = np.zeros(len(column))
    for at, to, cells, owners in _grams(buf, bounds):
        n = np.bincount(owners - at, minlength=to - at)[: to - at]
        count[at:to] += n
        if to == at + 1:
            total[at] += np.bincount(cells, minlength=len(odds)) @ odds
        else:
            own = np.flatnonzero(n)
            if len(own):
                total[at + own] += np.add.reduceat(odds[cells], np.r_[0, np.cumsum(n)[:-1]][own], axis=0)
    return total / np.sqrt(np.maximum(count, 1))[:, None]


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether a text has a letter of any script; a null has none."""
    buf, bounds = words.text_buffer(column)
    ascii_letter = ((buf | 32) >= 97) & ((buf | 32) <= 122)
    out, own = np.zeros(len(column), bool), np.flatnonzero(np.diff(bounds))
    if len(own):
        out[own] = np.logical_or.reduceat(ascii_letter, bounds[own])
    for i in np.flatnonzero(~out & (np.diff(bounds) > 0)):
        out[i] = any(map(str.isalpha, column[int(i)].as_py()))
    return out


def losses(margin: np.ndarray, model: Model) -> np.ndarray:
    """[text, language]: the weighted logistic loss of the margins against each codeword."""
    out = np.empty((len(margin), len(model.langs)))
    for i, word in enumerate(model.code):
        out[:, i] = np.logaddexp(0, -margin * word) @ model.weight
    return out


def _remainder(mod: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def fit(docs: DataFrame, sample: int = SAMPLE, mod: int = 4, held_out: int = 2) -> Model:
    """Learn from text and lang of rows with a lang whose crc32(doc_id) mod `mod` is known and not `held_out`.

    All languages of these rows are learned.  Of each language a sample of about `sample` rows, by the hash of doc_id,
    takes part, or all if they are fewer; of it every text is used whole.  The table of languages is collected.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"], docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (_remainder(mod) != held_out))
    there = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(there)
    if not langs:
        return Model([], np.ones((0, 1), np.float32), np.zeros((sum(CELLS), 1), np.float32), np.ones(1))
    place = F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col("doc_id")), 11) / float(2**53)
    often = [lang for lang in langs if there[lang] > sample]
    if often:
        share = F.create_map(*[x for lang in often for x in (F.lit(lang), F.lit(sample / there[lang]))])
        rows = rows.where(place < F.coalesce(share[F.col("lang")], F.lit(1.0)))
    rows = shared.written(rows.withColumn("back", F.pmod(F.xxhash64(F.lit(12), F.col("doc_id")), F.lit(5)) == 0), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {lang: i for i, lang in enumerate(langs)}
        sums = np.zeros((len(langs), sum(CELLS)), np.int64)
        for batch in batches:
            lang = np.array([number[x] for x in batch.column("lang").to_pylist()], int)
            for at, to, cells, owners in _grams(*words.text_buffer(batch.column("text"))):
                for one in np.unique(lang[at:to]):
                    sums[one] += np.bincount(cells[lang[owners] == one], minlength=sums.shape[1])
        one, cell = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(one.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(sums[one, cell])], names=["one", "cell", "n"])

    # one row for each language and cell at most
    fitted = {r.lang for r in rows.where("not back").select("lang").distinct().collect()}
    fitting = rows.where(~F.col("back") | ~F.col("lang").isin(*fitted)) if fitted else rows  # no language is left out
    counts = fitting.select("lang", "text").mapInArrow(count, "one int, cell int, n long").groupBy("one", "cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((len(langs), sum(CELLS)))
    table[counts.column("one").to_numpy(), counts.column("cell").to_numpy()] = counts.column("n").to_numpy()
    share = table + 0.5
    share /= share.sum(axis=1, keepdims=True)
    code = codewords(len(langs))
    odds = np.zeros((sum(CELLS), code.shape[1]), np.float32)
    if len(langs) > 1:
        for b in range(code.shape[1]):
            odds[:, b] = np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0))
    model = spark.sparkContext.broadcast((odds, code))  # cells times bits: the languages bound it, not the rows

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, code = model.value
        for batch in batches:
            lang = np.array([langs.index(x) for x in batch.column("lang").to_pylist()], int)
            right = (margins(batch.column("text"), odds) * code[lang] > 0).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(right), dtype=np.int32)), pa.array(right.astype(np.int64)), pa.array(np.full(len(right), len(lang)))], names=["bit", "ok", "n"])

    weight = np.ones(code.shape[1])
    for r in rows.where("back").select("lang", "text").mapInArrow(judge, "bit int, ok long, n long").groupBy("bit").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")).collect():
        accuracy = (r.ok + 1) / (r.n + 2)
        weight[r.bit] = max(0.05, 0.5 * np.log(accuracy / (1 - accuracy)))
    return Model(langs, code, odds, weight / weight.mean())


def identify(docs: DataFrame, model: Model | None = None, mod: int = 4, held_out: int = 2, lead: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, lang_pred, score, ambiguous and loss for every row; columns of those names are replaced.

    docs has doc_id and text, and lang if the model is learned here.  lang_pred is a learned language, or `und` where the
    text is null or has no letter, or where nothing could be learned; its score is then 0.  score, from 0 to 1, is the
    softmax of the losses; ambiguous tells that the two best losses are less than `lead` apart; loss is the best one for
    each bit (null for `und`).  A tie goes to the language that sorts first.  held_out is false for a null doc_id, whose row is not learned from either.  Whole texts
    are used, however long.  Repeated rows get equal results; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    model = model or fit(docs, sample, mod, held_out)
    shipped = spark.sparkContext.broadcast(tuple(model))  # a plain tuple: workers need no copy of the package to load it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shipped.value)
        for batch in batches:
            text = batch.column(at)
            n = len(text)
            pred, score, close, best_loss = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool), np.full(n, np.nan)
            judged = has_letter(text) & bool(model.langs)
            if judged.any():
                loss = losses(margins(text, model.odds), model)
                best = loss.argmin(axis=1)
                p = np.exp(loss.min(axis=1, keepdims=True) - loss)
                second = np.partition(loss, 1, axis=1)[:, 1] if len(model.langs) > 1 else np.full(n, np.inf)
                pred[judged] = np.array(model.langs, object)[best[judged]]
                score[judged] = 1 / p.sum(axis=1)[judged]
                close = judged & (second - loss.min(axis=1) < lead)
                best_loss[judged] = loss.min(axis=1)[judged] / max(float(model.weight.sum()), 1e-9)
            held = batch.columns[: len(out) - 4]
            yield pa.RecordBatch.from_arrays([*held, pa.array(list(pred), pa.string()), pa.array(score), pa.array(close), pa.array(best_loss, from_pandas=True)], names=out.names)

    new = NEW
    kept = docs.select(*[docs[c] for c in docs.columns if c not in new], F.coalesce(_remainder(mod) == held_out, F.lit(False)).alias("held_out"))
    schema = kept.selectExpr("*", "'' as lang_pred", "0d as score", "true as ambiguous", "cast(null as double) as loss").schema
    out = pa.schema([(f.name, pa.null()) for f in schema])
    if dict(docs.dtypes)["text"] == "string":  # a batch holds the texts once
        at = kept.columns.index("text")
        return kept.mapInArrow(run, schema)
    at = len(kept.columns)
    return kept.select("*", docs["text"].cast("string").alias("__text")).mapInArrow(run, schema)


def drop_unidentified(docs: DataFrame, floor: float = CHANCE) -> DataFrame:
    """The rows of docs that are in one of the learned languages, with the columns of docs.

    A null text and one without letters go, and so does a text whose codeword loses `floor` or more for each bit: its
    n-grams fit the bits of no language better than chance.  Texts that are ambiguous between two languages stay.  Where
    nothing can be learned, as lang is null throughout, every text with a letter stays; where only one language is, there
    is nothing to tell apart and the floor is not used.
    """
    renamed = docs.withColumnsRenamed({c: f"__kept_{c}" for c in NEW if c in docs.columns})
    model = fit(docs)
    found = identify(renamed, model)
    if not model.langs:
        fine = F.col("has_letters")
        found = with_letters(renamed)
    else:
        fine = (F.col("lang_pred") != "und") & ((F.col("loss") < floor) | F.lit(len(model.langs) < 2))
    return found.where(fine).select(*[F.col(f"__kept_{c}" if c in NEW else c).alias(c) for c in docs.columns])


def with_letters(docs: DataFrame) -> DataFrame:
    """docs with has_letters: whether the text has a letter of any script; columns of that name are replaced."""

    @F.pandas_udf("boolean")
    def letters(text):  # noqa: ANN001, ANN202
        return text.__class__(has_letter(pa.array(text, pa.string())))

    return docs.withColumn("has_letters", letters(docs["text"].cast("string")))
