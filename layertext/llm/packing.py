"""Packing documents into batches of a token budget, in length buckets of least padding.

The global histogram of lengths gives the bucket boundaries by dynamic programming, which are the best of all; inside a
bucket every document is padded to the longest length of the bucket, and a batch takes as many as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layertext.llm import mixing, shared

#: Parts into which each bucket is dealt to number its documents.
PARTS = 1024


def histogram(lengths: DataFrame) -> list[tuple[int, int]]:
    """(length, documents) of each length of the column `length` above 0, ascending.

    d different lengths have d * (d + 1) / 2 words at least, so the rows are at most the root of twice the corpus' words:
    some millions at 10^13 words.
    """
    rows = lengths.where("length > 0").groupBy("length").agg(F.count("*").alias("n"))
    return sorted((r.length, r.n) for r in rows.toLocalIterator())


def boundaries(lengths: list[tuple[int, int]], buckets: int) -> list[int]:
    """The upper lengths of at most `buckets` buckets with the least padding in all.

    best[j] after b rounds is the least sum of padded lengths of the lengths 0..j in b buckets.  A bucket that begins after
    i and ends at j costs longest[j] * (n[j] - n[i]): for each i a line in longest[j], whose slope falls with i; so the lower
    hull of the lines is a stack, and each round takes one pass.  All sums are whole numbers.
    """
    if not lengths:
        return []
    longest = [x for x, _ in lengths]
    n = [0]
    for _, count in lengths:
        n.append(n[-1] + count)
    size = len(lengths)
    best = [longest[j] * n[j + 1] for j in range(size)]
    choice: list[list[int]] = []
    for _ in range(min(buckets, size) - 1):
        previous, best, cut = [0, *best], [0] * size, [0] * size
        hull: list[int] = []
        at = 0
        for j in range(size):
            # line i: previous[i] - longest * n[i]; drop lines that the new one makes useless
            while len(hull) >= 2:
                a, b = hull[-2], hull[-1]
                if (previous[j] - previous[a]) * (n[b] - n[a]) <= (previous[b] - previous[a]) * (n[j] - n[a]):
                    hull.pop()
                else:
                    break
            hull.append(j)
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and previous[hull[at + 1]] - longest[j] * n[hull[at + 1]] <= previous[hull[at]] - longest[j] * n[hull[at]]:
                at += 1
            i = hull[at]
            best[j], cut[j] = previous[i] + longest[j] * (n[j + 1] - n[i]), i
        choice.append(cut)
    out, j = [], size - 1
    for cut in reversed(choice):
        out.append(longest[j])
        j = cut[j] - 1
        if j < 0:
            break
    if j >= 0:
        out.append(longest[j])
    return sorted(set(out))


def pack(docs: DataFrame, budget: int = 16_384, buckets: int = 16, length: Column | None = None) -> DataFrame:
    """doc_id, length, bucket, width (length after padding), batch and place of each row of docs (doc_id, text).

    length: by default the words of the text.  Every batch holds documents of one bucket, and width times its documents
    is at most the budget; only the last batch of a bucket may hold fewer than fit.  A document that is longer than the
    budget is a batch of its own.  A null or blank text has length 0 and no bucket, width, batch or place (null).
    Repeated rows are packed each.  Buckets are numbered from 0 by length; batches from 0 in each bucket.  An empty
    table gives an empty result.  Other columns are ignored.
    """
    found = F.coalesce(length, F.lit(0)).cast("long") if length is not None else mixing.word_count(docs["text"])
    rows = docs.select(docs["doc_id"], found.alias("length"), F.xxhash64(docs["doc_id"], docs["text"]).alias("tie"))
    rows = shared.written(rows, "lengths")  # else every use of a length counts the words again
    ends = boundaries(histogram(rows), buckets)
    tops = F.array(*[F.lit(e).cast("long") for e in ends]).cast("array<long>")
    bucket = F.size(F.filter(tops, lambda e: e < F.col("length")))
    some = F.col("length") > 0
    rows = rows.withColumn("bucket", F.when(some, bucket)).withColumn("width", F.when(some, F.get(tops, F.col("bucket"))))
    rows = rows.withColumn("part", F.pmod("tie", F.lit(PARTS)).cast("int"))
    full = rows.where("length > 0")
    at = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = full.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    offsets = offsets.select(F.col("bucket").alias("b"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(at), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("bucket", "part").orderBy("length", "doc_id", "tie"))
    # there is one offset for each bucket and part at most: buckets * PARTS rows
    same = (F.col("bucket") == F.col("b")) & (F.col("part") == F.col("p"))
    full = full.withColumn("number", number - 1).join(F.broadcast(offsets) if buckets * PARTS <= shared.BROADCAST_ROWS else offsets, same)
    per = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("width")))
    full = full.withColumn("number", F.col("number") + F.col("offset"))
    packed = full.select("doc_id", "length", "bucket", "width", F.floor(F.col("number") / per).alias("batch"), (F.col("number") % per).alias("place"))
    none = F.lit(None)
    rest = rows.where("length = 0").select("doc_id", "length", none.cast("int").alias("bucket"), none.cast("long").alias("width"), none.cast("long").alias("batch"), none.cast("long").alias("place"))
    return packed.unionByName(rest)
