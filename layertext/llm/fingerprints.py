"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph (a line) is cut every CELL bytes; the digests of the cuts, numbered among equals, are the elements of a
text.  Each element goes into one cell of each third of a sketch, which keeps counts, sums of elements and sums of their
checks.  The sketches of two versions are subtracted, and peeling pure cells recovers the elements in which they differ;
where peeling fails the sketches are built again twice as large, until they are larger than both versions' elements; then
the elements themselves are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layertext.llm import shared
from layertext.llm.words import mix

#: Bytes of a cut; cells of the sketch that a fingerprint shows, and with which a comparison begins.
CELL, BASE = 64, 12
#: Rows of a range of doc_ids, and the most ranges.
RANGE_ROWS, RANGES = 500, 16_384
_RAW = np.random.default_rng(20240301).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = np.multiply.accumulate(np.r_[np.uint64(1), np.full(CELL, np.uint64(0x9E3779B97F4A7C15))])
_SEEDS = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def elements(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The elements of all texts, and each text's bounds in them.  Blank lines give none."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    ends = np.unique(np.r_[np.flatnonzero(buf == 10), bounds[1:]])
    starts = np.r_[0, ends[:-1] + (buf[np.minimum(ends[:-1], max(0, len(buf) - 1))] == 10 if len(buf) else 0)] if len(ends) else ends
    starts = np.minimum(starts, ends)
    full = ends > starts
    starts, ends = starts[full], ends[full]
    number = -(-(ends - starts) // CELL)
    first = np.repeat(starts, number) + CELL * (np.arange(number.sum()) - np.repeat(np.r_[0, np.cumsum(number)[:-1]] if len(number) else number, number))
    size = np.minimum(CELL, np.repeat(ends, number) - first)
    out = np.empty(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(first), 1 << 14):
            s, n = first[i : i + (1 << 14)], size[i : i + (1 << 14)]
            at = np.r_[0, np.cumsum(n)[:-1]]
            place = np.arange(n.sum()) - np.repeat(at, n)
            out[i : i + len(s)] = np.add.reduceat(_RAW[buf[np.repeat(s, n) + place]] * _POWER[place], at) ^ n.astype(np.uint64)
        out = mix(out)
        cuts = np.searchsorted(first, bounds)
        owner = np.repeat(np.arange(len(texts)), np.diff(cuts))
        order = np.lexsort((out, owner))
        same = np.r_[False, (out[order][1:] == out[order][:-1]) & (owner[order][1:] == owner[order][:-1])] if len(out) else np.zeros(0, bool)
        run = np.arange(len(out)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(out)))) if len(out) else np.zeros(0, np.int64)
        rank = np.empty(len(out), np.uint64)
        rank[order] = run.astype(np.uint64)
        return mix(out + rank * np.uint64(0xD6E8FEB86659FD93)), cuts


class Sketches:
    """Sketches of several texts, or differences of texts, side by side: sketch i has cells[i] cells, a multiple of 3."""

    def __init__(self, cells: np.ndarray) -> None:
        self.cells, self.base = cells, np.r_[0, np.cumsum(cells)]
        self.count = np.zeros(self.base[-1], np.int64)
        self.key, self.check = np.zeros(self.base[-1], np.uint64), np.zeros(self.base[-1], np.uint64)

    def add(self, owner: np.ndarray, x: np.ndarray, sign: np.ndarray) -> None:
        with np.errstate(over="ignore"):
            third = (self.cells[owner] // 3).astype(np.uint64)
            times = sign.astype(np.int64).view(np.uint64)
            key, check = x * times, mix(x) * times
            for i, seed in enumerate(_SEEDS):
                at = self.base[owner] + (i * third + mix(x ^ seed) % third).astype(np.int64)
                np.add.at(self.count, at, sign)
                np.add.at(self.key, at, key)
                np.add.at(self.check, at, check)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(owner, element, sign) of what was recovered, and whether each sketch was emptied."""
        of = np.repeat(np.arange(len(self.cells)), self.cells)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.arange(len(of))
        with np.errstate(over="ignore"):
            # a cell that only seems pure could be peeled again and again; a sketch holds no more elements than cells
            while sum(len(x) for x, _, _ in found) <= len(of):
                one = look[np.abs(self.count[look]) == 1]
                x = self.key[one] * self.count[one].view(np.uint64)
                pure = mix(x) * self.count[one].view(np.uint64) == self.check[one]
                one, x = one[pure], x[pure]
                if not len(one):
                    break
                _, first = np.unique(np.stack([of[one].astype(np.uint64), x]), axis=1, return_index=True)
                owner, x, sign = of[one][first], x[first], self.count[one][first]
                self.add(owner, x, -sign)
                found.append((owner, x, sign))
        left = np.add.reduceat((self.count != 0) | (self.key != 0), self.base[:-1]) if len(self.cells) else np.zeros(0)
        parts = [np.concatenate(p) for p in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        return (*parts, left == 0)


def changes(a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, sign): the elements of each text of a that are not in its partner of b (1), or the other way round (-1)."""
    n = len(a_bounds) - 1
    cells, both = np.full(n, BASE), np.diff(a_bounds) + np.diff(b_bounds)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    todo = np.arange(n)
    while len(todo):
        # the larger sketches go in portions of bounded size
        portion = todo[: max(1, int(np.searchsorted(np.cumsum(cells[todo] + both[todo]), 1 << 19)))]
        todo = todo[len(portion) :]
        sketch = Sketches(cells[portion])
        for x, bounds, sign in ((a, a_bounds, 1), (b, b_bounds, -1)):
            size = bounds[portion + 1] - bounds[portion]
            at = np.repeat(bounds[portion] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            sketch.add(np.repeat(np.arange(len(portion)), size), x[at], np.full(size.sum(), sign))
        owner, x, sign, done = sketch.peel()
        kept = done[owner]
        out.append((portion[owner[kept]], x[kept], sign[kept]))
        cells[portion] *= 2
        failed = portion[~done]
        for i in failed[cells[failed] > 8 * both[failed] + 8 * BASE]:
            mine, other = a[a_bounds[i] : a_bounds[i + 1]], b[b_bounds[i] : b_bounds[i + 1]]
            for x, sign in ((np.setdiff1d(mine, other), 1), (np.setdiff1d(other, mine), -1)):
                out.append((np.full(len(x), i), x, np.full(len(x), sign)))
        todo = np.r_[todo, failed[cells[failed] <= 8 * both[failed] + 8 * BASE]]
    owner, x, sign = (np.concatenate(c) for c in zip(*out, strict=True))
    by = np.lexsort((x, sign, owner))
    return owner[by], x[by], sign[by]


def differences(a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray) -> np.ndarray:
    """How many elements of each text of a are not in its partner of b, or the other way round, by peeling."""
    return np.bincount(changes(a, a_bounds, b, b_bounds)[0], minlength=len(a_bounds) - 1)


def likeness(a: np.ndarray, a_bounds: np.ndarray, b: np.ndarray, b_bounds: np.ndarray) -> np.ndarray:
    """Shared elements over all elements; 1 for two texts without any."""
    return _alike(differences(a, a_bounds, b, b_bounds), a_bounds, b_bounds)


def _alike(apart: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> np.ndarray:
    both = np.diff(a_bounds) + np.diff(b_bounds)
    shared_elements = (both - apart) / 2
    return np.where(both > 0, shared_elements / np.maximum(shared_elements + apart, 1), 1.0)


def shown(x: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The fingerprint strings: the number of elements and the cells of the base sketch in hexadecimal digits."""
    n = len(bounds) - 1
    sketch = Sketches(np.full(n, BASE))
    sketch.add(np.repeat(np.arange(n), np.diff(bounds)), x, np.ones(len(x), np.int64))
    cells = np.zeros((n * BASE, 3), ">u8")
    cells[:, 0], cells[:, 1], cells[:, 2] = sketch.count, sketch.key, sketch.check
    raw = cells.tobytes()
    step = BASE * 24
    return [f"{size}:{raw[i * step : (i + 1) * step].hex()}" for i, size in enumerate(np.diff(bounds))]


def edited(text: str, after: str) -> str:
    """text with its last quarter, in code points, replaced by the first as many of the next text, or all."""
    cut = len(text) // 4
    return text[: len(text) - cut] + after[:cut]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, last, doc_id, text), dealt so that a bucket holds a range of doc_ids and, last, the next range's first row."""
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(-(2**63)))
    rows = docs.select(key.alias("key"), docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    there = rows.count()
    ranges = int(min(RANGES, max(1, there // RANGE_ROWS)))
    ends = sorted(set(rows.select("key").approxQuantile("key", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 and there else []
    ends = np.array(sorted({int(e) for e in ends}), np.int64)  # RANGES numbers at most

    @F.pandas_udf("int")
    def bucket(key):  # noqa: ANN001, ANN202
        return key.__class__(np.searchsorted(ends, key.to_numpy(), "left").astype(np.int32))

    rows = rows.withColumn("bucket", bucket("key"))
    firsts = sorted((r.bucket, r.key) for r in rows.select("bucket", "key").groupBy("bucket").agg(F.min("key").alias("key")).collect())
    before = {key: firsts[i - 1][0] for i, (_, key) in enumerate(firsts)}  # the range before; of the first, the last
    table = docs.sparkSession.createDataFrame([(k, b) for k, b in before.items()], "first long, prior int")
    rows = rows.join(F.broadcast(table), F.col("key") == F.col("first"), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("last"))
    lent = F.struct(F.col("prior").alias("bucket"), F.lit(1).alias("last"))
    rows = rows.withColumn("x", F.explode(F.when(F.col("prior").isNull(), F.array(own)).otherwise(F.array(own, lent))))
    rows = rows.select("x.bucket", "x.last", "key", "doc_id", "text", F.xxhash64("text").alias("tie"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "last", "key", "tie").select("bucket", "last", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, removed and added of every row
    of docs.

    removed and added are the digests of the paragraphs that the edit takes away and brings in, as peeling recovers them.

    docs has doc_id and text; a null text counts as empty.  The next document is that of the next larger doc_id, after
    the last the first; rows that repeat a doc_id follow one another in the order of a hash of their texts, and a null
    doc_id comes first.  A single document is its own next.  Equal texts have equal fingerprints, and likeness 1.  Whole
    texts are used.  An empty table gives an empty result.  Other columns are ignored.
    """
    shared.small_batches(docs.sparkSession)

    def work(rows: list[tuple[int, int, int | None, str]]) -> pa.RecordBatch:
        texts = [r[3] for r in rows]
        pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        changed = [edited(texts[i], texts[i + 1]).encode() for i in pairs]
        x, bounds = elements([t.encode() for t in texts])
        y, y_bounds = elements(changed)
        at = np.array(pairs, int)

        def chosen(index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            size = bounds[index + 1] - bounds[index]
            where = np.repeat(bounds[index] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(index) else np.zeros(0, int)
            return x[where], np.r_[0, np.cumsum(size)]

        own, after = chosen(at), chosen(at + 1)
        owner, digest, sign = changes(*own, y, y_bounds)
        apart = np.bincount(owner, minlength=len(at))
        lists = []
        for one in (1, -1):
            ends = np.searchsorted(owner[sign == one], np.arange(len(at) + 1)).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(digest[sign == one].view(np.int64))))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in pairs], pa.int64()),
                pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
                pa.array(shown(*own), pa.string()),
                pa.array(shown(y, y_bounds), pa.string()),
                pa.array(_alike(apart, own[1], y_bounds), pa.float64()),
                pa.array(likeness(*own, *after), pa.float64()),
                *lists,
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "removed", "added"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.append(row)
                size += len(row[3])
                if size > 1 << 21 and len(held) > 1:
                    yield work(held)
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield work(held)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, removed array<long>, added array<long>"
    return with_next(docs).mapInArrow(run, schema)
