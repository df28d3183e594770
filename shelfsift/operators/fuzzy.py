"""Misspelt words: query terms joined to the vocabulary within an edit distance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsift.functions.distance import MAX_EDITS, auto_edits, deletion_keys, edit_distance
from shelfsift.operators.postings import near_terms
from shelfsift.operators.sizes import hinted, is_small, materialized


def deletion_index(vocab: DataFrame) -> DataFrame:
    """(field, key, term): the vocabulary under its deletion keys."""
    return vocab.select("field", "term", F.explode(deletion_keys(F.col("term"), F.lit(MAX_EDITS))).alias("key"))


def _near(keyed: DataFrame, vocab: DataFrame, longest: Column, keys: DataFrame | None) -> DataFrame:
    """(field, key, term) of the words that any of the keyed query words may reach."""
    if keys is None:
        return deletion_index(vocab.filter(F.length("term") <= longest))
    return near_terms(keys, keyed, is_small(keyed), "key").select("field", "term", "key")


def similar_terms(wanted: DataFrame, vocab: DataFrame, edits: Callable[[Column], Column] = auto_edits,
                  prefix_length: int = 0, keys: DataFrame | None = None) -> DataFrame:
    """(field, q_term, term, typos) within the allowed edits; ``keys`` are the stored keys of the vocabulary.

    Both sides meet on equal deletion keys, so the distance is only computed
    for pairs that share one; no term is compared with the whole vocabulary.
    Vocabulary terms longer than any query term can reach are left out first.
    """
    q = wanted.select("field", F.col("term").alias("q_term")).distinct().withColumn("edits", edits(F.col("q_term")))
    longest = q.select(F.max(F.length("q_term") + F.col("edits"))).scalar()
    keyed = q.select("*", F.explode(deletion_keys(F.col("q_term"), F.col("edits"))).alias("key"))
    near = _near(keyed, vocab, longest, keys)
    pairs = near.join(hinted(keyed, is_small(keyed)), ["field", "key"]).filter(
        F.abs(F.length("q_term") - F.length("term")) <= F.col("edits")
    ).select("field", "q_term", "term", "edits").distinct()
    guard = F.substring("q_term", 1, prefix_length) == F.substring("term", 1, prefix_length)
    pairs = pairs.filter(guard) if prefix_length else pairs
    return pairs.withColumn("typos", edit_distance(F.col("q_term"), F.col("term"))).filter(
        F.col("typos") <= F.col("edits")
    ).drop("edits")


def expand_terms(terms: DataFrame, vocab: DataFrame, edits: Callable[[Column], Column] = auto_edits,
                 prefix_length: int = 0, max_expansions: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Query terms replaced by their spellings in the vocabulary.

    Adds ``typos`` and ``weight`` = 1 - typos / length of the shorter word.
    All spellings are kept, unless ``max_expansions`` asks for the closest of each term only.
    The result is materialised: scoring reads it several times, and the
    vocabulary behind it takes a pass over the corpus.
    """
    near = similar_terms(terms, vocab, edits, prefix_length, keys)
    if max_expansions is not None:
        rank = F.row_number().over(W.partitionBy("field", "q_term").orderBy("typos", "term"))
        near = near.withColumn("_rank", rank).filter(F.col("_rank") <= max_expansions).drop("_rank")
    shorter = F.least(F.length("q_term"), F.length("term"))
    near = near.withColumn("weight", 1 - F.col("typos") / shorter)
    return materialized(terms.withColumnRenamed("term", "q_term").join(near, ["field", "q_term"]))
