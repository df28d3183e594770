"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsift.llm.common import joined, stored

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Adds ``weight``: the sources by code point, null last, take the weights in turn. One row per source."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, epochs: int = 3) -> DataFrame:
    """Adds ``target`` to sources(source, source_size, weight).

    The total size is shared by weight; sources above ``epochs`` times their size are clamped and the excess
    is shared anew by weight until none is above. Each round is one sum over the sources; the level only
    rises, so a clamped source stays clamped. Weights of null or at most zero get nothing.
    """
    weight = F.greatest(F.coalesce(F.col("weight"), F.lit(0)), F.lit(0))
    cap = F.col("source_size").cast("long") * epochs
    level = F.when(weight > 0, cap / weight)

    def sums(clamped: Column) -> tuple[int, int]:
        return tuple(sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)) - F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~clamped, weight)), F.lit(0)),
        ).first())

    clamped, (rest, share) = F.lit(False), sums(F.lit(False))
    while share:
        clamped = F.coalesce(level < rest / share, F.lit(False))
        found = sums(clamped)
        if found == (rest, share):
            break
        rest, share = found
    # As doubles: a weight and a rest below 2 ** 31 are both ints, whose product need not be one.
    open_target = weight.cast("double") * F.lit(float(rest)) / F.lit(float(share or 1))
    return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(open_target))


def mix(
    docs: DataFrame, weights=cycled_weights, epochs: int = 3, seed: int = 7, key: str = "doc_id",
) -> DataFrame:
    """One row per document: its columns, size, source_size, target, repeats, part and taken words.

    A source gives each document ``repeats`` whole times, and a seeded order of its documents fills the
    rest: ``part`` is the words of one more repetition, all of them before the point where the target is met,
    some of them for the document at that point. So the words taken meet the rounded target. The order comes
    from a hash of seed and key; 4096 ranges of that hash are summed first, so no source is gathered.
    Null texts and texts without words have size 0; a null source is a source; equal keys of equal
    size are interchangeable. An empty table gives an empty result.
    """
    rows = docs.withColumn("size", word_count(F.col("text")))
    rows = rows.withColumn("__hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    rows = rows.withColumn("__range", F.substring("__hash", 1, 3))
    ranges = stored(rows.groupBy("source", "__range").agg(F.sum("size").alias("__words")), "mix-ranges")
    sources = ranges.groupBy("source").agg(F.sum("__words").alias("source_size"))
    targets = stored(water_fill(stored(weights(sources), "mix-sources"), epochs), "mix-targets").drop("weight")
    earlier = W.partitionBy("source").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.withColumn("__start", F.coalesce(F.sum("__words").over(earlier), F.lit(0))).drop("__words")
    starts = joined(starts, targets, ["source"])
    placed = joined(rows, starts, ["source", "__range"])
    inside = W.partitionBy("source", "__range").orderBy("__hash", "size").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("__start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    goal = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(goal / F.greatest("source_size", F.lit(1)))).otherwise(0)
    rest = F.col("__goal") - F.col("repeats") * F.col("source_size") - F.col("__before")
    return (
        placed.withColumns({"__before": before, "__goal": goal, "repeats": whole.cast("long")})
        .withColumn("part", F.greatest(F.lit(0), F.least(rest, F.col("size"))).cast("long"))
        .withColumn("__drawn", rest > 0)
        .withColumn("taken", F.col("size") * F.col("repeats") + F.col("part"))
        .drop("__hash", "__range", "__start", "__before", "__goal")
    )
