"""Typo-tolerant search ranked by a ladder of criteria instead of a weighted score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.functions.distance import ladder_edits
from shelfsift.operators.fuzzy import expand_terms
from shelfsift.operators.match import SCORE_DIGITS
from shelfsift.operators.postings import TextIndex, near_terms, query_terms, vocabulary
from shelfsift.operators.rank import with_spans
from shelfsift.operators.sizes import hinted, is_small

# Span of words that do not all occur in one field.
NO_SPAN = 1_000_000


def ladder_terms(index: TextIndex, queries: DataFrame) -> DataFrame:
    """Query words with every spelling of theirs in the vocabulary; they match, and they are what hits are marked with."""
    return expand_terms(query_terms(queries, index.fields), vocabulary(index), ladder_edits, keys=index.keys)


def ladder_matches(index: TextIndex, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, words, typos, span, attribute, exact, n_terms, score) for ``ladder_terms``.

    Criteria in order: more words matched, fewer typos, words closer together,
    an earlier attribute, more exact words. ``score`` folds the first three
    into (0, 1].
    """
    spelled = terms.select("query_id", "field", "slot", "n_terms", "term", "typos")
    small = is_small(spelled)
    postings = near_terms(index.positions, spelled, small).select("doc_id", "field", "field_no", "term", "pos")
    hits = postings.join(hinted(spelled, small), ["field", "term"]).repartition("query_id", "doc_id")
    # The closest span and the best spelling come out of one pass over the hits.
    spans = with_spans(hits.withColumn("weight", F.lit(1.0)), ["query_id", "doc_id", "field"])
    rows = spans.groupBy("query_id", "doc_id", "slot", "n_terms").agg(
        F.min("typos").alias("typos"), F.min("field_no").alias("attribute"),
        F.min(F.col("end") - F.col("pos") + 1).alias("span"),
    ).groupBy("query_id", "doc_id", "n_terms").agg(
        F.count(F.lit(1)).alias("words"), F.sum("typos").alias("typos"), F.min("attribute").alias("attribute"),
        F.count_if(F.col("typos") == 0).alias("exact"), F.coalesce(F.min("span"), F.lit(NO_SPAN)).alias("span"),
    )
    n = F.col("n_terms")
    fine = (2 * n - F.col("typos") + 1 / (1 + F.col("span"))) / (2 * n + 1)
    return rows.withColumn("score", F.round((F.col("words") - 1 + fine) / n, SCORE_DIGITS))


def ladder_order(*sort: Column) -> list[Column]:
    """Order of the hits; an attribute sort comes after words and typos."""
    return [
        F.desc("words"), F.asc("typos"), *sort, F.asc("span"), F.asc("attribute"), F.desc("exact"), F.asc("doc_id"),
    ]
