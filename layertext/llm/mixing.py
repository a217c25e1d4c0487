"""Mixing sources to target weights by Pareto order sampling.

A source whose target is r times its words takes each document floor(r) times for certain.  The rest of the target is
met by a sample without replacement, in which long documents are more likely than short ones: p_i, the chance that
document i is included, is in proportion to a power of its words times its weight, and so scaled that the words of the
rest are expected.  Where p_i would be 1 or more, the document is one more certain copy, and the chances of the others
are scaled anew to what is left, until all are below 1.  Then document i gets the rank
[u_i / (1 - u_i)] / [p_i / (1 - p_i)], with u_i hashed from its doc_id, and the least ranks are taken until the words of
the rest are reached.  So the size of the sample is fixed, counted in words, and reruns agree.

The cut in the ranks is found by two histograms per source and a running sum inside one of 2^24 cells: no source is
sorted as a whole and texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layertext.llm import shared

CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(shared.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, size) rows, one a source -> source, source_size, target.

    Sources in the order of their code points, null last, get the weights in turn.  The targets share `share` times all
    sizes by weight; none exceeds `most` times its source, and the excess is shared again by weight among the others.
    The table has one row a source; its running sums need one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.select("source", F.col("size").alias("source_size"), F.element_at(cycle, (F.row_number().over(order) - 1) % len(weights) + 1).alias("w"))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("w"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    s = s.withColumn("k", F.row_number().over(up))
    s = s.withColumn("before", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - F.col("before")) / F.col("left"))
    s = s.withColumn("at", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("k", "level"))).over(whole))
    return s.select("source", "source_size", F.when(F.col("k") >= F.col("at.k"), F.col("at.level") * F.col("w")).otherwise(F.col("cap")).alias("target"))


def _sampled(docs: DataFrame, weight: str | None, seed: int) -> dict[str, Column]:
    """What sampling needs of a row beside its source."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), docs["doc_id"]), 11).cast("double") + 0.5) / F.lit(float(2**53))
    factor = F.greatest(F.coalesce(docs[weight].cast("double"), F.lit(1.0)), F.lit(1e-6)) if weight else F.lit(1.0)
    return {"__size": word_count(docs["text"]), "__tie": F.xxhash64(docs["doc_id"], docs["text"]), "__u": u, "__weight": factor}


def _measured(docs: DataFrame, weight: str | None, power: float, seed: int) -> DataFrame:
    """source, __size, __tie, __u and __weight of each row and its other columns, the measure being taken of the size."""
    rows = docs.withColumns(_sampled(docs, weight, seed))
    return rows.withColumn("__weight", F.col("__weight") * F.pow(F.greatest("__size", F.lit(1)), F.lit(float(power))))


def _rank(p: Column, u: Column) -> Column:
    """The Pareto rank, mapped from (0, infinity) to (0, 1)."""
    odds = p / (1 - p)
    rank = (u / (1 - u)) / odds
    return F.least(rank / (1 + rank), F.lit(1 - 2.0**-53))


def _plan(ranked: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row a source: source_size, target, whole (certain copies of all), rest (words that are left for the sample), scale
    (p_i over the weight, for the documents that are not certain), sure (from this weight on they are), and the cut."""
    sums = shared.written(ranked.groupBy("source").agg(F.sum("__size").alias("size")), "sources")
    plan = targets(sums, weights, share, most)
    copies = F.try_divide("target", "source_size")
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(copies + 1e-12)).otherwise(0).cast("int"))
    plan = plan.withColumn("rest", F.round(F.col("target")) - F.col("whole") * F.col("source_size"))
    plan = shared.written(plan.withColumn("sure", F.lit(float("inf"))), "plan")

    # chances of 1 and more make documents certain, which leaves less for the others, until none is added
    while True:
        known = shared.join_small(ranked, plan.select("source", "sure"), ["source"])
        free = F.col("__weight") < F.col("sure")
        left = known.groupBy("source").agg(
            F.sum(F.when(free, F.col("__size") * F.col("__weight"))).alias("weighted"),
            F.sum(F.when(~free, F.col("__size")).otherwise(0)).alias("certain"),
            F.max(F.when(free & (F.col("__size") > 0), F.col("__weight"))).alias("heaviest"),
        )
        scaled = shared.join_small(plan.drop("weighted", "certain", "heaviest", "scale"), shared.written(left, "left"), ["source"])
        scaled = scaled.withColumn("scale", F.when(F.col("rest") > F.col("certain"), F.try_divide(F.col("rest") - F.col("certain"), "weighted")).otherwise(0.0))
        scaled = scaled.withColumn("sure", F.when(F.col("heaviest") * F.col("scale") >= 1, 1 / F.col("scale")).otherwise(F.col("sure")))
        done = scaled.where(F.col("heaviest") * F.col("scale") >= 1).isEmpty()
        plan = shared.written(scaled, "plan")
        if done:
            break
    plan = plan.withColumn("rest", F.greatest(F.col("rest") - F.col("certain"), F.lit(0.0))).drop("weighted", "certain", "heaviest")
    plan = shared.written(plan, "plan")

    # a boundary cell holds the rank up to which the words of the rest reach
    rows = placed(ranked, plan).where("rest > 0 and not certain").select("source", "rest", F.col("__size").alias("size"), "rank", "__tie")
    rows = rows.withColumn("c1", F.floor(F.col("rank") * CELLS)).withColumn("c2", F.floor(F.col("rank") * CELLS * CELLS))
    start = plan.select("source", F.lit(0.0).alias("base"))
    for cell in ("c1", "c2"):
        sums = rows.groupBy("source", "rest", cell).agg(F.sum("size").alias("words"))
        sums = shared.join_small(sums, start.select("source", "base"), ["source"])
        upto = F.sum("words").over(Window.partitionBy("source").orderBy(cell)) + F.col("base")
        edge = sums.withColumn("upto", upto).where("upto >= rest").groupBy("source")
        edge = edge.agg(F.min(F.struct(cell, (F.col("upto") - F.col("words")).alias("base"))).alias("x"))
        start = shared.written(edge.select("source", F.col(f"x.{cell}").alias("edge"), F.col("x.base").alias("base")), "edge")
        rows = shared.join_small(rows, start, ["source"]).where(F.col(cell) == F.col("edge")).drop("edge", "base")
    last = shared.join_small(rows, start.select("source", "base"), ["source"])
    running = Window.partitionBy("source").orderBy("rank", "__tie")
    last = last.withColumn("off", F.abs(F.sum("size").over(running.rowsBetween(Window.unboundedPreceding, 0)) + F.col("base") - F.col("rest")))
    last = last.withColumn("without", F.abs(F.col("base") - F.col("rest")))
    best = last.groupBy("source").agg(F.min(F.struct("off", "rank", "__tie")).alias("x"), F.first("without").alias("without"))
    cuts = best.select(
        "source",
        F.when(F.col("x.off") <= F.col("without"), F.col("x.rank")).otherwise(-1.0).alias("cut_rank"),
        F.col("x.__tie").alias("cut_tie"),
    )
    low = start.select("source", (F.col("edge") / float(CELLS * CELLS)).alias("low"))
    cuts = shared.join_small(shared.written(cuts, "cuts"), low, ["source"])
    plan = shared.join_small(plan, shared.written(cuts, "cuts"), ["source"], "left")
    return shared.written(plan, "plan")


def placed(ranked: DataFrame, plan: DataFrame) -> DataFrame:
    """ranked with its source's plan, certain (whether the sample takes it in any case) and its rank."""
    joined = shared.join_small(ranked, plan, ["source"])
    p = F.least(F.greatest(F.col("scale") * F.col("__weight"), F.lit(1e-12)), F.lit(1 - 1e-12))
    certain = (F.col("__weight") >= F.col("sure")) & (F.col("__size") > 0)
    return joined.withColumns({"certain": F.coalesce(certain, F.lit(False)), "rank": _rank(p, F.col("__u"))})


def _copies() -> Column:
    """How often a placed row is taken."""
    cut = (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("__tie") <= F.col("cut_tie")))
    sampled = F.coalesce((F.col("rank") < F.col("low")) | cut, F.lit(False)) & (F.col("__size") > 0)
    return (F.col("whole") + (F.col("certain") | sampled).cast("int")).cast("int")


def mixture(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, weight: str | None = None, power: float = 0.5, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies * size) for each row of docs.

    docs has doc_id, text and source; the chance of a document is in proportion to its words to the `power`, times the
    column that `weight` may name (null: 1).  Documents of equal rank are taken in the order of a hash of doc_id and text.
    A null or blank text has size 0: it never gets a place in the sample, only the certain copies of its source.
    A null source is a source of its own, the last.  Repeated rows count each; those that are equal in doc_id and text
    are taken alike.  An empty table gives an empty result.  Other columns are ignored.
    """
    needed = _measured(docs, weight, power, seed).select(docs["doc_id"], docs["source"], "__size", "__tie", "__u", "__weight")
    needed = shared.written(needed, "sizes")
    rows = placed(needed, _plan(needed, weights, share, most)).withColumn("copies", _copies())
    return rows.select("doc_id", "source", F.col("__size").alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col("__size")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.0, most: float = 3.0, weight: str | None = None, power: float = 0.5, seed: int = 1) -> DataFrame:
    """The documents of the mix, each as often as mixture() takes it, with the columns of docs.  Texts are not shuffled."""
    names = ["__size", "__tie", "__u", "__weight"]
    needed = shared.written(_measured(docs, weight, power, seed).select("source", *names), "sizes")
    plan = _plan(needed, weights, share, most)
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), "doc_id", "source", "text", *([weight] if weight else []))
    rows = placed(_measured(whole, weight, power, seed).select("__row", "source", *names), plan)
    rows = rows.withColumn("__copies", _copies()).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies"))).select("__row.*")
