"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set holds its distinct five-word shingles.  Its sketch is the k least hashes of the set.  The steps:

1. Documents with equal sets form one class; only one sketch of a class goes on.
2. Inverted lists of the retained values.  Two linked documents share most of their sketches, so they meet in a list of
   one of their rarest retained values already (prefix filtering): only those rarest values get lists.  Short lists give
   all their pairs.  Long lists, which are families of copies or passages of many documents, give each member a pair with
   two pivots only.  What the pivots leave apart gets inverted lists of its full sets, of each set's rarest shingles only:
   linked sets share one of them for certain.  Short lists again give all pairs.  Only sets of which nearly all shingles are
   common are compared with one another in blocks of bounded size.
3. The union's sketch estimates the similarity of a pair and drops pairs far below the threshold.
4. The full sets confirm or reject each remaining pair: first each class's best partner, then the pairs between
   components that are still apart.  Pairs inside a component can't change it.

The chance that a linked pair is lost by a sketch is below 1e-5; every link that is used is confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layertext.llm import shared, words

#: Retained values of a sketch.
K = 48
#: Lists of at most so many members give all their pairs.
SHORT = 12
#: A shingle of at most so many of the sets that are left apart gives all pairs of them.
RARE = 32
#: Shingles of a block of sets, and of a part of a bundle, that meet in one task.
BLOCK, PART = 1 << 17, 1 << 19


def floor_of(percent: int, k: int = K) -> float:
    """The share of a sketch that a linked pair has in common but for a chance of about 1e-5: 4.5 deviations below."""
    t = percent / 100
    return t - 4.5 * math.sqrt(t * (1 - t) / k)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame, width: int = 5, k: int = K) -> DataFrame:
    """doc_id, th (hash of the text), n (size of the set), sig (digest of the set, null if empty), sketch."""
    shared.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = words.shingle_sets(batch.column("text"), width)
            least = [s[:k] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("th"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(s) for s in least])].astype(np.int32), np.concatenate([*least, np.zeros(0, np.int64)])),
                ],
                names=["doc_id", "th", "n", "sig", "sketch"],
            )

    return _texts(docs).mapInArrow(run, "doc_id long, th long, n long, sig binary, sketch array<long>")


def _candidates(reps: DataFrame, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows (v, sig, n, rare) of the inverted lists, and pairs (a, b) of signatures, a < b, that come from them."""
    floor = floor_of(percent, k)
    values = reps.select("sig", "n", F.size("sketch").alias("kept"), F.explode("sketch").alias("v"))
    # written, so that a value of very many sketches can be split in the join
    common = shared.written(values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "common")
    own = values.join(common, "v").groupBy("sig", "n", "kept").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
    reach = F.col("kept") - F.ceil(F.col("kept") * floor) + 1 - (F.col("kept") - F.size("vs"))
    own = own.withColumn("vs", F.slice("vs", F.lit(1), F.greatest(F.lit(0), reach).cast("int")))
    rows = own.select("sig", "n", (F.col("kept") - F.size("vs")).alias("rare"), F.posexplode("vs").alias("pos", "x")).select(
        "sig", "n", "rare", F.col("x.v").alias("v"), (F.col("x.df") > SHORT).alias("long"), "pos"
    )
    rows = shared.written(rows, "lists")
    fits = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    short = rows.where("not long").select("v", "sig", "n")
    other = short.select("v", F.col("sig").alias("b"), F.col("n").alias("m"))
    pairs = short.withColumnRenamed("sig", "a").join(other, "v").where(f"a < b and {fits}").select("a", "b")
    long = rows.where("long")
    pivots = long.groupBy("v").agg(
        F.min(F.struct("rare", "n", "sig")).alias("central"), F.min(F.struct(F.xxhash64("sig", "v").alias("h"), "n", "sig")).alias("any")
    )
    pivots = pivots.select("v", F.explode(F.array(F.struct("central.sig", "central.n"), F.struct("any.sig", "any.n"))).alias("p")).select(
        "v", F.col("p.sig").alias("b"), F.col("p.n").alias("m")
    )
    pivots = shared.written(pivots, "pivots")
    few = long.where("pos < 6").select("v", F.col("sig").alias("a"), "n")
    hung = few.join(pivots, "v").where(f"a != b and {fits}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return rows, pairs.unionByName(hung).distinct()


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs whose similarity, as the sketch of their union estimates it, may reach the threshold."""
    sketch = reps.select("sig", "sketch")
    both = pairs.join(sketch.select(F.col("sig").alias("a"), F.col("sketch").alias("sa")), "a").join(
        sketch.select(F.col("sig").alias("b"), F.col("sketch").alias("sb")), "b"
    )
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    both = both.select("a", "b", F.array_intersect("sa", "sb").alias("common"), union.alias("u"))
    est = F.size(F.array_intersect("u", "common")) / F.size("u")
    return both.select("a", "b", est.alias("est")).where(F.col("est") >= floor_of(percent, k))


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full sets of their texts (sig, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(words.shingle_sets(batch.column("ta"), width), words.shingle_sets(batch.column("tb"), width), strict=True):
                same = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(100 * same >= percent * (len(left) + len(right) - same))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    both = pairs.select("a", "b").join(texts.select(F.col("sig").alias("a"), F.col("text").alias("ta")), "a")
    both = both.join(texts.select(F.col("sig").alias("b"), F.col("text").alias("tb")), "b")
    return both.mapInArrow(run, "a binary, b binary")


def _roots(edges: DataFrame) -> DataFrame:
    return shared.components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    at = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    bt = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    joined = pairs.join(at, "a", "left").join(bt, "b", "left")
    return joined.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*pairs.columns)


def _class_texts(nodes: DataFrame, sketched: DataFrame, docs: DataFrame) -> DataFrame:
    """(sig, text): one text of each class in nodes (sig)."""
    none = F.lit(-(2**63))
    wanted = sketched.join(nodes, "sig").groupBy("sig").agg(F.min(F.struct(F.coalesce("doc_id", none).alias("id"), "th")).alias("at"))
    texts = _texts(docs).withColumn("id", F.coalesce("doc_id", none)).join(wanted.select("sig", "at.id", "at.th"), ["id", "th"]).select("sig", "text")
    repeated = not texts.select("sig").groupBy("sig").count().where("count > 1").isEmpty()
    return texts.groupBy("sig").agg(F.any_value("text").alias("text")) if repeated else texts


def _confirmed(pairs: DataFrame, reps: DataFrame, sketched: DataFrame, docs: DataFrame, percent: int, width: int) -> DataFrame:
    """Confirmed edges that connect what all confirmed pairs (a, b, est) would connect."""
    nodes = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct()
    texts = shared.written(_class_texts(nodes, sketched, docs), "texts")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "est"))
    best = both.groupBy("a").agg(F.max(F.struct("est", "b")).alias("x")).select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b")).distinct()
    best = shared.written(_verified(best, texts, percent, width), "links")
    rest = shared.written(_apart(pairs, _roots(best)).select("a", "b"), "apart")
    if rest.isEmpty():
        return best
    return shared.written(best.unionByName(_verified(rest, texts, percent, width)), "links")


def _linked_sets(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sets (sig, set) links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column("sa"), batch.column("sb"), strict=True):
                left, right = left.values.to_numpy(), right.values.to_numpy()
                same = len(np.intersect1d(left, right, assume_unique=True))
                linked.append(100 * same >= percent * (len(left) + len(right) - same))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    both = pairs.join(sets.select(F.col("sig").alias("a"), F.col("set").alias("sa")), "a")
    both = both.join(sets.select(F.col("sig").alias("b"), F.col("set").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _left_over(rows: DataFrame, sketched: DataFrame, docs: DataFrame, roots: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) within long lists that join what the pivots left in different components, judged on full sets.

    Lists with the same central member form one bundle, so a family of copies meets about once.  Members of bundles that
    are not one component are open.  A set of n shingles that is linked with another shares p percent of its shingles with
    it, so of all but so many of them, taken in one order for all sets, at least one is shared: these are its leads.
    The order puts the shingles first that few open sets have; so a line that many texts hold is no lead of a text with
    enough words of its own.  Leads of few sets give pairs.  Sets with leads of many sets are nearly all common: they are
    dealt into blocks and parts by their shingles, and each block meets each part of its bundle in a group of bounded size,
    which returns a spanning forest of the links between components.  So the output grows with the members, not their pairs.
    """
    long = rows.where("long")
    central = long.groupBy("v").agg(F.min(F.struct("rare", "n", "sig")).alias("c")).select("v", F.col("c.sig").alias("p"))
    members = long.join(shared.written(central, "central"), "v").select("p", "sig", "n").distinct()
    members = members.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("p", "sig", "n", F.coalesce("root", "sig").alias("root"))
    members = shared.written(members, "members")
    sizes = members.groupBy("p", "root").agg(F.count("*").alias("c"))
    bundles = sizes.groupBy("p").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("m"), F.max("c").alias("top")).where("m > top")
    bundles = shared.written(bundles.select("p", "main"), "bundles")
    members = shared.written(members.join(bundles, "p"), "open")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("sig"), pa.array(words.shingle_sets(batch.column("text"), width), pa.list_(pa.int64()))], names=["sig", "set"])

    texts = _class_texts(members.select("sig").distinct(), sketched, docs)
    sets = shared.written(texts.mapInArrow(hashes, "sig binary, set array<long>"), "sets")

    values = sets.select("sig", F.explode("set").alias("x"))
    counts = shared.written(values.groupBy("x").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    own = sets.select("sig", F.size("set").alias("n"), F.explode("set").alias("x")).join(counts, "x").groupBy("sig", "n")
    own = own.agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("xs"))
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("xs"))
    leads = own.select("sig", "n", F.explode(F.slice("xs", F.lit(1), F.greatest(F.lit(0), reach).cast("int"))).alias("x")).select("sig", "n", "x.df", "x.x")
    leads = shared.written(leads, "leads")

    asks = members.where("root != main").select("sig").distinct()
    at = members.select("sig", "root").distinct()
    few = leads.where(F.col("df") <= RARE).select("sig", "n", "x").join(at, "sig")
    mine = few.join(asks, "sig", "left_semi").select("x", F.col("sig").alias("a"), "n", F.col("root").alias("ra"))
    other = few.select("x", F.col("sig").alias("b"), F.col("n").alias("m"), F.col("root").alias("rb"))
    pairs = mine.join(other, "x").where(f"ra != rb and 100 * least(n, m) >= {percent} * greatest(n, m)")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = _linked_sets(pairs, sets, percent)

    common = leads.where(F.col("df") > RARE).select("sig").distinct()
    members = shared.written(members.join(common, "sig").drop("n").join(sets, "sig").withColumn("h", F.xxhash64("sig")), "common")
    if members.isEmpty():
        return found
    weigh = lambda what, unit: F.greatest(F.lit(1), F.ceil(F.sum(what) / unit))
    dealt = members.groupBy("p").agg(weigh(F.when(F.col("root") != F.col("main"), F.size("set")), BLOCK).alias("blocks"), weigh(F.size("set"), PART).alias("parts"), F.count_if(F.col("root") != F.col("main")).alias("open"))
    members = members.join(shared.written(dealt.where("open > 0").drop("open"), "dealt"), "p")
    kept = ["p", "sig", "root", "set", "block", "part", "asks"]
    types = {c: F.col(c).cast("long") for c in ("block", "part")}
    asks = members.where("root != main").withColumn("block", F.pmod("h", "blocks")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meets = members.withColumn("part", F.pmod("h", "parts")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = asks.withColumn("asks", F.lit(True)).withColumns(types).select(kept).unionByName(meets.withColumn("asks", F.lit(False)).withColumns(types).select(kept))

    def run(group: pa.Table) -> pa.Table:
        out: list[tuple[bytes, bytes]] = []
        asking = group.filter(group.column("asks"))
        meeting = group.filter(pa.compute.invert(group.column("asks")))
        if len(asking) and len(meeting):
            left, right = ([x.values.to_numpy() for x in t.column("set")] for t in (asking, meeting))
            size = np.array([len(x) for x in right])
            starts = np.r_[0, np.cumsum(size)[:-1]]
            known, code = np.unique(np.concatenate(right), return_inverse=True)
            sig_l, sig_r = asking.column("sig").to_pylist(), meeting.column("sig").to_pylist()
            root_l, root_r = asking.column("root").to_pylist(), meeting.column("root").to_pylist()
            number = {r: i for i, r in enumerate({*root_l, *root_r})}
            of_r = np.array([number[r] for r in root_r])
            up = list(range(len(number)))

            def top(i: int) -> int:
                while up[i] != i:
                    up[i] = i = up[up[i]]
                return i

            for mine, sig, root in zip(left, sig_l, root_l, strict=True):
                mark = np.zeros(len(known) + 1, bool)
                place = np.searchsorted(known, mine)
                mark[place[known[np.minimum(place, len(known) - 1)] == mine]] = True
                same = np.add.reduceat(mark[code], starts, dtype=np.int64)
                hit = np.flatnonzero(100 * same >= percent * (size + len(mine) - same))
                for r, j in zip(*np.unique(of_r[hit], return_index=True), strict=True):
                    x, y = top(number[root]), top(int(r))
                    if x != y:
                        up[x] = y
                        out.append((min(sig, sig_r[hit[j]]), max(sig, sig_r[hit[j]])))
        return pa.table({"a": pa.array([x for x, _ in out], pa.binary()), "b": pa.array([y for _, y in out], pa.binary())})

    return found.unionByName(dealt.groupBy("p", "block", "part").applyInArrow(run, "a binary, b binary")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, k: int = K) -> DataFrame:
    """Every row of docs (doc_id, text) with the component of near copies that it belongs to.

    Returns doc_id, th (xxhash64 of the text), n_shingles (size of the set), component_id (the smallest doc_id that can be
    reached through links of 100 * intersection >= percent * union, its own included) and kept (doc_id = component_id).

    A null or blank text has an empty set and is linked with nothing.  A text of fewer than `width` words is one shingle.
    Rows with equal sets are linked.  Which of several equally near partners is compared first changes the work, not the
    components.  Repeated rows stay and get the same component.  A row with a null doc_id takes part;
    it is kept only if no row of its component has a doc_id.  An empty table gives an empty result.  Other columns are ignored.
    """
    sketched = shared.written(sketches(docs, width, k), "sketches")
    full = sketched.where("sig is not null")
    reps = shared.written(full.groupBy("sig").agg(F.min("doc_id").alias("label"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")), "classes")
    rows, pairs = _candidates(reps, percent, k)
    pairs = shared.written(_estimated(pairs, reps, percent, k), "pairs")
    links = _confirmed(pairs, reps, sketched, docs, percent, width)
    roots = shared.written(_roots(links), "roots")
    if not rows.where("long").isEmpty():
        more = shared.written(_left_over(rows, sketched, docs, roots, percent, width), "more")
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = shared.written(_roots(links), "roots")
    classes = reps.select("sig", "label").join(roots.withColumnRenamed("node", "sig"), "sig", "left")
    linked = classes.where("root is not null")
    least = linked.groupBy("root").agg(F.min("label").alias("least"))
    labels = classes.where("root is null").select("sig", F.col("label").alias("least")).unionByName(linked.join(least, "root").select("sig", "least"))
    labels = shared.written(labels, "labels")  # a set of very many copies can then be split in the join
    empty = F.col("sig").isNull()
    return (
        sketched.select("doc_id", "th", F.col("n").alias("n_shingles"), "sig")
        .join(labels, "sig", "left")
        .withColumn("component_id", F.when(empty, F.col("doc_id")).otherwise(F.col("least")))
        .select("doc_id", "th", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """docs with one document of each group of near copies, that with the smallest doc_id; columns as before.

    Of rows that repeat a doc_id and a group, one stays.  A null or blank text is a group of its own.
    """

    def choose() -> DataFrame:
        found = near_duplicates(docs, percent, width).where("kept")
        one = found.groupBy("doc_id", F.when(F.col("n_shingles") > 0, F.lit(0)).otherwise(F.col("th")).alias("empty")).agg(F.min("th").alias("th"))
        return one.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))

    chosen = shared.result(docs.sparkSession, choose, "kept")
    same = [docs["doc_id"].cast("long").eqNullSafe(chosen["__id"]), F.xxhash64(docs["text"]) == chosen["__th"]]
    out = docs.join(chosen, same, "left_semi")
    repeated = not out.groupBy("doc_id", F.xxhash64("text")).count().where("count > 1").isEmpty()
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out
