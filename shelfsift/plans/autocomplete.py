"""Search as you type with title suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.operators import highlight, limits, suggest
from shelfsift.operators.postings import TextIndex, query_terms
from shelfsift.plans.search import NO_INDEX, SearchIndex, SearchResult, few_hits


def title_index(products: DataFrame, title: str = "title") -> TextIndex:
    """Words, pairs and triples of the titles; saved next to a table it serves every prefix without reading the titles."""
    return TextIndex.of(products, suggest.suggest_fields(title), "product_id")


def search_as_you_type(products: DataFrame, queries: DataFrame, k: int = 10, title: str = "title",
                       stored: SearchIndex = NO_INDEX) -> SearchResult:
    """Hits with marked titles, and their total."""
    index = stored.titles or title_index(products, title)
    scores = suggest.prefix_search(index, queries)
    page = limits.top_k(scores, k, [F.desc("score"), F.asc("doc_id")]).select("query_id", "doc_id", "score", "rank")
    words = highlight.spelled_terms(query_terms(queries, index.fields[:1]))
    rows = highlight.with_source(page, products, "product_id", words, few_hits(queries, k))
    marked = highlight.highlight_map({title: highlight.fragments(F.col(title), F.col("terms"), 100, 5)})
    return SearchResult(rows.withColumn("highlights", marked).drop("terms"), limits.match_totals(scores))


def suggest_titles(products: DataFrame, queries: DataFrame, n: int = 5, stored: SearchIndex = NO_INDEX) -> DataFrame:
    """Distinct titles of the first ``n`` hits of every prefix."""
    hits = search_as_you_type(products, queries, n, stored=stored).hits
    return suggest.suggestions(hits, queries, n)
