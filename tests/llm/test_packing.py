import itertools
import random
from collections import defaultdict

from layertext.llm import packing


def padding(lengths, ends):
    total, low = 0, 0
    for e in sorted(ends):
        total += sum((e - m) * n for m, n in lengths if low < m <= e)
        low = e
    return total


def test_boundaries_are_optimal():
    r = random.Random(5)
    for _ in range(60):
        sizes = sorted(r.sample(range(1, 100), r.randrange(1, 9)))
        lengths = [(m, r.randrange(1, 30)) for m in sizes]
        for buckets in (1, 2, 3, 4):
            got = packing.boundaries(lengths, buckets)
            assert got[-1] == sizes[-1] and len(got) <= buckets
            best = min(padding(lengths, [*c, sizes[-1]]) for n in range(buckets) for c in itertools.combinations(sizes[:-1], min(n, len(sizes) - 1)))
            assert padding(lengths, got) == best


def test_boundaries_of_many_lengths_equal_a_plain_table():
    r = random.Random(8)
    for size in (60, 200):
        lengths = [(m, r.choice([1, 1, 5, 1000])) for m in sorted(r.sample(range(1, 10**6), size))]
        for buckets in (2, 5, 16):
            best = [padding(lengths[: j + 1], [lengths[j][0]]) for j in range(size)]
            for _ in range(buckets - 1):
                # the last bucket begins after i
                best = [min([best[j], *(best[i] + padding(lengths[i + 1 : j + 1], [lengths[j][0]]) for i in range(j))]) for j in range(size)] if size < 100 else None
                if best is None:
                    break
            got = packing.boundaries(lengths, buckets)
            if best is not None:
                assert padding(lengths, got) == best[-1]
            assert len(got) == min(buckets, size) and padding(lengths, got) <= padding(lengths, [lengths[(i + 1) * size // buckets - 1][0] for i in range(buckets)])


def test_padding_of_documents_is_the_least(spark):
    r = random.Random(6)
    rows = [(i, "w " * r.choice([3, 130, 131, 150, 200, 900, 905, 2000])) for i in range(120)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), buckets=3).collect()
    sizes = sorted({x.length for x in out})
    best = min(sum(min(e for e in ends if e >= x.length) - x.length for x in out) for c in itertools.combinations(sizes[:-1], 2) for ends in [[*c, sizes[-1]]])
    assert sum(x.width - x.length for x in out) == best


def test_batches(spark):
    r = random.Random(2)
    rows = [(i % 900, " ".join("w" * 1 for _ in range(r.choice([1, 2, 5, 30, 31, 200, 3000])))) for i in range(1000)] + [(None, "a b"), (5000, None), (5001, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as bucket", "2 as part")
    out = packing.pack(df, budget=256, buckets=4).collect()
    assert sorted(x.length for x in out) == sorted(len((t or "").split()) for _, t in rows)
    batches, widths = defaultdict(list), {}
    for x in out:
        if not x.length:
            assert x.bucket is None and x.batch is None
            continue
        assert x.length <= x.width and widths.setdefault(x.bucket, x.width) == x.width
        batches[x.bucket, x.batch].append(x)
    for (bucket, batch), xs in batches.items():
        per = max(1, 256 // xs[0].width)
        assert sorted(x.place for x in xs) == list(range(len(xs)))
        last = max(b for k, b in batches if k == bucket)
        assert len(xs) == per or batch == last and len(xs) <= per
    assert packing.pack(df.limit(0)).collect() == []
