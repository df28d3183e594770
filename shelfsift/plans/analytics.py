"""Analytics over the reviews a query matches, in three dialects, and over all reviews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.functions.text import ENGLISH_REVIEW, Analyzer
from shelfsift.operators import enrich, facets, limits
from shelfsift.operators.sizes import materialized
from shelfsift.plans.search import NO_INDEX, SearchIndex, fitting_reviews, review_matches

# Hits the ladder dialect looks at for its averages.
SAMPLE = 1000


@dataclass(frozen=True)
class Analytics:
    """Brand metrics, category counts, rating distribution and summary per query."""

    brands: DataFrame
    categories: DataFrame
    ratings: DataFrame
    summary: DataFrame


def matched_reviews(reviews: DataFrame, products: DataFrame, queries: DataFrame, dialect: str,
                    analyzer: Analyzer = ENGLISH_REVIEW, stemming: bool = False, keep: bool = True,
                    stored: SearchIndex = NO_INDEX):
    """(matches with rating, votes, brand and category; hit order) for all four reports.

    The reports read the matches several times, so they are computed once and
    kept in the shared folder; ``keep=False`` leaves them lazy.
    """
    matches, _, order = review_matches(
        reviews, queries, dialect, analyzer, fuzziness=False, stemming=stemming, stored=stored
    )
    fitting = fitting_reviews(matches, reviews, queries, "helpful_vote", "product_id")
    attributes = products.select("product_id", "brand", "category")
    how = "inner" if dialect == "weighted" else "left"
    rows = fitting.join(attributes, "product_id", how).fillna({"brand": "Unknown", "category": "Electronics"})
    return (materialized(rows) if keep else rows), order


def review_analytics(reviews: DataFrame, products: DataFrame, queries: DataFrame, dialect: str,
                     analyzer: Analyzer = ENGLISH_REVIEW, stemming: bool = False,
                     stored: SearchIndex = NO_INDEX) -> Analytics:
    rows, order = matched_reviews(reviews, products, queries, dialect, analyzer, stemming, stored=stored)
    by = ["query_id"]
    if dialect == "lucene":
        bundle = facets.analytics_bundle(rows, by)
        part = lambda name: bundle.filter(F.col("facet") == name).drop("facet")
        return Analytics(part("brand"), part("category"), part("rating"), part("summary"))
    if dialect == "ladder":
        sample = limits.top_k(rows, SAMPLE, order)
        return Analytics(
            facets.sampled_brand_metrics(rows, sample, by), facets.category_counts(rows, by),
            facets.value_counts(rows, "rating", by), facets.sampled_summary(rows, sample, by),
        )
    return Analytics(
        facets.brand_metrics(rows, by), facets.category_counts(rows, by),
        facets.value_counts(rows, "rating", by), facets.summary(rows, by),
    )


def overall_analytics(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """What each dialect reports without a query, in long form (engine, metric, value)."""
    product_row = facets.product_review_metrics(products)
    review_row = facets.review_metrics(reviews)
    names = ["avg_rating", "review_count", "helpful_votes"]
    long = lambda df, engine: df.select(
        F.lit(engine).alias("engine"),
        F.inline(F.array(*[
            F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names
        ])),
    )
    ladder = facets.rating_facet(products).select(
        F.lit("ladder").alias("engine"),
        F.concat_ws("=", "facet", "value").alias("metric"), F.col("n").cast("double").alias("value"),
    )
    return long(product_row, "lucene").unionByName(ladder).unionByName(long(review_row, "weighted"))
