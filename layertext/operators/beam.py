"""Beam search over token scores, as one DataFrame expression for each step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the decoder: the start and end tokens, and the beams of one sequence that may end.
START, END, FINISHED = 1, 2, 2


def top_tokens(logits: DataFrame, k: int = 5) -> DataFrame:
    order = Window.partitionBy("vec_id", "step").orderBy(F.col("lg").desc(), "tok")
    return logits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _grown(token: Column) -> Callable[[Column, Column], Column]:
    """The continuations of a beam by the ranked tokens of a step; the array of beams gives it its place i."""

    def grow(b: Column, i: Column) -> Column:
        def one(t: Column) -> Column:
            tok = F.when(b["ended"], F.lit(END)).otherwise(t["tok"])
            score = b["score"] + F.when(b["ended"], F.lit(0).cast("long")).otherwise(t["lg"])
            return F.struct((-score).alias("key"), i.alias("i"), t["rank"].alias("r"), F.concat(b["tokens"], F.array(tok)).alias("tokens"), score.alias("score"), (b["ended"] | (tok == END)).alias("ended"))

        return F.transform(token, one)

    return grow


def search(logits: DataFrame, k: int = 5, steps: int = 4) -> DataFrame:
    """(vec_id, tokens, score, ended) of the best beam of each sequence.

    A beam that has ended goes on with k end tokens that cost nothing, so it may double and end a sequence alone; a
    sequence stops when FINISHED beams have ended, and its best beam, ended or not, is taken.  At the limit the first
    beam is taken.  Ties go to the earlier beam and the smaller token.
    """
    ranked = top_tokens(logits, k).groupBy("vec_id", "step").agg(F.sort_array(F.collect_list(F.struct("rank", "tok", "lg"))).alias("best"))
    wide = ranked.groupBy("vec_id").agg(F.map_from_entries(F.collect_list(F.struct("step", "best"))).alias("steps"))
    first = F.transform(F.element_at("steps", F.lit(0)), lambda t: F.struct(F.array(t["tok"]).alias("tokens"), t["lg"].alias("score"), (t["tok"] == END).alias("ended")))
    state = wide.select("vec_id", "steps", first.alias("beams"))
    for step in range(1, steps):
        grow = _grown(F.element_at("steps", F.lit(step)))
        grown = F.slice(F.array_sort(F.flatten(F.transform("beams", grow))), 1, k)
        done = F.size(F.filter("beams", lambda b: b["ended"])) >= FINISHED
        kept = F.transform(grown, lambda b: F.struct(b["tokens"].alias("tokens"), b["score"].alias("score"), b["ended"].alias("ended")))
        state = state.withColumn("beams", F.when(done, F.col("beams")).otherwise(kept))
    top = F.element_at("beams", 1)
    return state.select("vec_id", F.array_join(F.transform(top["tokens"], lambda t: t.cast("string")), " ").alias("tokens"), top["score"].alias("score"), top["ended"].alias("ended"))


#: Fixed values of a dictionary: the entries that begin and end a text, and the one that is a space.
START_ENTRY, END_ENTRY, SPACE_ENTRY = "<S>", "</S>", "<SP>"
#: Entries of a dictionary that is broadcast.
ENTRIES = 200_000


def detokenised(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(vec_id, text) of tokens (vec_id, step, tok): their entries in the dictionary (tok, char) up to the end, in order.

    Start entries are skipped and space entries are spaces.  A token without an entry is left out.
    """
    small = dictionary.limit(ENTRIES + 1).count() <= ENTRIES
    rows = tokens.join(F.broadcast(dictionary) if small else dictionary, "tok", "left")
    rows = rows.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("step", "char"))).alias("t"))
    chars = F.col("t.char")
    end = F.array_position(chars, F.lit(END_ENTRY))
    kept = F.when(end > 0, F.slice(chars, F.lit(1), (end - 1).cast("int"))).otherwise(chars)
    letters = F.transform(F.filter(kept, lambda c: c != START_ENTRY), lambda c: F.when(c == SPACE_ENTRY, F.lit(" ")).otherwise(c))
    return rows.select("vec_id", F.array_join(letters, "").alias("text"))


def folded_colours(tokens: DataFrame) -> DataFrame:
    """(vec_id, fg, bg) of tokens (vec_id, fg, bg, has_fg, has_bg): the mean colours of a text from those of its tokens.

    fg and bg are three numbers from 0 to 1, which become whole levels.  A token without a foreground has no part in the
    mean; one without a background counts with its foreground there.  Means are cut to whole levels of 0..255; none is 0.
    """
    level = lambda c, i: (F.get(c, F.lit(i)) * 255).cast("int")
    mean = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.coalesce(F.avg(x), F.lit(0.0)).cast("int")))
    front = [mean(F.when(F.col("has_fg"), level("fg", i))) for i in range(3)]
    back = [mean(F.when(F.col("has_bg"), level("bg", i)).otherwise(level("fg", i))) for i in range(3)]
    return tokens.groupBy("vec_id").agg(F.array(*front).alias("fg"), F.array(*back).alias("bg"))
