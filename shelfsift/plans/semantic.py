"""Semantic next to keyword search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.operators import limits, match, vectors
from shelfsift.operators.postings import TextIndex, query_terms
from shelfsift.operators.sizes import materialized


def query_vectors(queries: DataFrame, dimensions: int = vectors.DIMENSIONS,
                  model: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """(query_id, embedding) by a model, or by feature hashing."""
    if model is not None:
        return vectors.embed_column(queries, "query_id", "q", model).withColumnRenamed("doc_id", "query_id")
    return vectors.dense(vectors.hashed_features(queries, "query_id", "q", dimensions), dimensions).withColumnRenamed(
        "doc_id", "query_id"
    )


def semantic_and_keyword(index: TextIndex, embedded: DataFrame, queries: DataFrame, boosts: dict[str, float],
                         k: int = 10, dimensions: int = vectors.DIMENSIONS, approximate: bool = False,
                         model: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Both sections in one table: (section, query_id, doc_id, score, rank, total).

    The total of the vector section is the number of neighbours found, that of
    the keyword section all documents with enough of the words.
    """
    asked = query_vectors(queries, dimensions, model)
    if approximate:
        near = vectors.candidate_neighbours(embedded, asked, k, dimensions)
    else:
        near = vectors.exact_neighbours(embedded, asked, k)
    # A few rows per query that the page and the totals both read.
    near = materialized(near)
    found = limits.match_totals(near)
    semantic = near.join(found, "query_id").withColumn("section", F.lit("semantic"))
    scores = match.minimum_match_scores(index, query_terms(queries, index.fields))
    keyword = limits.page_with_total(
        match.best_field(scores, boosts), k, [F.desc("score"), F.asc("doc_id")]
    ).withColumn("section", F.lit("keyword"))
    columns = ["section", "query_id", "doc_id", "score", "rank", "total"]
    return semantic.select(*columns).unionByName(keyword.select(*columns))
