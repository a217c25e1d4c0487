import random

from layertext.llm import minhash


def brute(rows, percent):
    def shingles(text):
        w = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(sets[i]), least.get(top(i)), d == least.get(top(i))) for i, (d, _) in enumerate(rows)), key=repr)


def family(seed=1, copies=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    line = [r.choice(vocabulary) for _ in range(60)]
    rows, base = [], [r.choice(vocabulary) for _ in range(150)]
    for i in range(copies):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((1000 - i, " ".join(w)))
    for i in range(60):
        rows.append((2000 + i, " ".join(line + [r.choice(vocabulary) for _ in range(r.choice([5, 20, 200]))])))
    return rows


def found(spark, rows, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.near_duplicates(df, percent).select("doc_id", "n_shingles", "component_id", "kept").collect()
    return sorted((tuple(x) for x in out), key=repr)


def test_families_and_common_passages(spark):
    rows = family()
    assert found(spark, rows, 85) == brute(rows, 85)


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (3, "one TWO"), (9, "a b c d e"), (10, "a b c d e"), (None, "a b c d e"), (11, "é É x"), (11, "é É x")]
    want = brute(rows, 85)
    got = found(spark, rows, 85)
    assert [(d, n, c) for d, n, c, _ in got] == [(d, n, c) for d, n, c, _ in want]


def test_one_stays(spark):
    df = spark.createDataFrame([(1, "x y z"), (2, "x y z"), (3, None), (4, "q"), (4, "q")], "doc_id long, text string").selectExpr("*", "1 as th", "2 as sig", "3 as __id")
    out = minhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_what_pivots_leave_apart(spark, monkeypatch):
    """Families around one common text whose members are linked with one another, not with the whole family."""
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(9000)]
    base = [r.choice(vocabulary) for _ in range(120)]
    rows = []
    for g in range(30):
        half = list(base)
        for _ in range(4):
            half[r.randrange(len(half))] = r.choice(vocabulary)
        for _ in range(4):
            w = list(half)
            if r.random() < 0.6:
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(w)))
    want = brute(rows, 85)
    assert found(spark, rows, 85) == want
    for rare in (0, 1000):  # all by blocks, all by leads
        monkeypatch.setattr(minhash, "RARE", rare)
        monkeypatch.setattr(minhash, "BLOCK", 700)
        monkeypatch.setattr(minhash, "PART", 1500)
        assert found(spark, rows, 85) == want


def test_a_common_line_gives_no_leads(spark):
    r = random.Random(7)
    line = [f"l{i}" for i in range(30)]
    rows = [(i, " ".join([*line, *[f"w{r.randrange(10**6)}" for _ in range(10)]])) for i in range(300)]
    rows += [(1000 + i, rows[i][1] + " end") for i in range(20)]
    assert found(spark, rows, 85) == brute(rows, 85)


def test_texts_beyond_one_piece(spark, monkeypatch):
    from layertext.llm import words

    monkeypatch.setattr(words, "PIECE", 300)
    r = random.Random(3)
    base = [f"v{r.randrange(5000)}" for _ in range(900)]
    rows = [(i, " ".join(base[: 900 - 20 * i])) for i in range(4)] + [(9, "x" * 1000), (10, "x" * 1000)]
    assert found(spark, rows, 85) == brute(rows, 85)
