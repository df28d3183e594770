"""Ranking from term positions: weighted frequency and cover density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsift.operators.match import SCORE_DIGITS
from shelfsift.operators.postings import near_terms
from shelfsift.operators.sizes import hinted, is_small

# Beyond every position: a word that does not occur again.
_NEVER = 2**31 - 1


def _placed(positions: DataFrame, slots: DataFrame) -> DataFrame:
    """Occurrences of the ranking words, placed by (query, document) for all later steps."""
    small = is_small(slots)
    return near_terms(positions, slots, small).join(hinted(slots, small), "term").repartition("query_id", "doc_id")


def frequency_rank(positions: DataFrame, slots: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): sum over occurrences of class weight / i², by number of words.

    ``i`` numbers the occurrences of a word in a document, the weightiest
    first. Of several alternatives of a query the best counts.
    """
    keys = ["query_id", "grp", "doc_id"]
    nth = F.row_number().over(W.partitionBy(*keys, "slot").orderBy(F.desc("weight"), "pos"))
    hits = _placed(positions, slots).withColumn("nth", nth)
    per_group = hits.groupBy(*keys, "n_terms").agg(F.sum(F.col("weight") / (F.col("nth") * F.col("nth"))).alias("s"))
    return per_group.groupBy("query_id", "doc_id").agg(
        F.round(F.max(F.col("s") / F.col("n_terms")), SCORE_DIGITS).alias("score")
    )


def _of_word(keys: list[str]):
    return W.partitionBy(*keys, "slot").orderBy("pos", "weight")


def with_spans(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Each occurrence with ``end`` of the shortest span that starts at it, null where none does.

    A span starts at an occurrence once every word has been seen and each earlier occurrence has been followed
    by another one of its word; it must end before the occurrence's own word comes again. Queries may have any
    number of words. The windows run within the matched positions of a document.
    """
    earlier = W.partitionBy(*keys).orderBy("pos").rangeBetween(W.unboundedPreceding, -1)
    whole, same = W.partitionBy(*keys), _of_word(keys)
    marked = hits.withColumns({
        "_next": F.coalesce(F.lead("pos").over(same), F.lit(_NEVER)), "_first": F.row_number().over(same) == 1,
    })
    marked = marked.withColumns({
        "_followed": F.coalesce(F.max("_next").over(earlier), F.lit(0)),
        "_words": F.count(F.when(F.col("_first"), 1)).over(whole),
        "_seen": F.max(F.when(F.col("_first"), F.col("pos"))).over(whole),
    })
    end = F.greatest("pos", "_followed", "_seen")
    return marked.select(*hits.columns, F.when((F.col("_words") == F.col("n_terms")) & (end < F.col("_next")), end).alias("end"))


def covers(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Shortest spans that hold every word of a query (Clarke, Cormack & Tudhope 2000), at most one per start.

    ``weight`` is the harmonic mean of the weights that the words last had before the end. Occurrences and ends
    are put in one order, in which each occurrence replaces what its word weighed before.
    """
    inverse = 1 / F.col("weight")
    change = inverse - F.coalesce(F.lag(inverse).over(_of_word(keys)), F.lit(0.0))
    events = F.array(
        F.struct(F.col("pos").alias("at"), F.lit(False).alias("closes"), "change", F.lit(None).cast("int").alias("start")),
        F.struct(F.col("end").alias("at"), F.lit(True).alias("closes"), F.lit(0.0).alias("change"), F.col("pos").alias("start")),
    )
    placed = with_spans(hits, keys).withColumn("change", change).select(*keys, "n_terms", F.inline(events))
    so_far = W.partitionBy(*keys).orderBy("at", "closes").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = placed.filter("at IS NOT NULL").withColumn("inverse", F.sum("change").over(so_far)).filter("closes")
    found = summed.groupBy(*keys, "start").agg(
        F.min("at").alias("end"), F.max(F.col("n_terms") / F.col("inverse")).alias("weight"))
    return found.withColumn("length", F.col("end") - F.col("start") + 1)


def cover_rank(positions: DataFrame, slots: DataFrame, weighted: bool = True) -> DataFrame:
    """(query_id, doc_id, score): sum of 1 / span length, scaled by the class weights."""
    keys = ["query_id", "grp", "doc_id"]
    spans = covers(_placed(positions, slots), keys)
    share = (F.col("weight") if weighted else F.lit(1.0)) / F.col("length")
    per_group = spans.groupBy(*keys).agg(F.sum(share).alias("s"))
    return per_group.groupBy("query_id", "doc_id").agg(F.round(F.max("s"), SCORE_DIGITS).alias("score"))
