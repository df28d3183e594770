"""Joins of reviews and products at load time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.operators.limits import first_per_key

# No broadcast hints here: the optimizer broadcasts a side whose measured size
# is below its threshold and otherwise shuffles, splitting skewed keys.


def join_products(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Reviews with their product's attributes; reviews of unknown products drop out."""
    attributes = products.select(
        "product_id", F.col("title").alias("product_title"), "brand", "category"
    )
    return reviews.join(attributes, "product_id")


def of_known_products(reviews: DataFrame, products: DataFrame, key: str = "product_id") -> DataFrame:
    return reviews.join(products.select(key), key, "left_semi")


def cap_per_product(reviews: DataFrame, cap: int | None, order: str = "ord") -> DataFrame:
    """The first ``cap`` reviews of each product in input order; none or 0 lifts the cap."""
    return first_per_key(reviews, ["product_id"], [F.asc(order)], cap)


def enrich_products(products: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Products with their review aggregate, zeros where there is none."""
    columns = ["avg_review_rating", "loaded_review_count", "helpful_votes", "review_text"]
    joined = products.join(aggregates.select("product_id", *columns), "product_id", "left")
    filled = joined.fillna(0, columns[:3]).fillna("", columns[3:])
    return filled.withColumn("title_suggest", F.coalesce("title", F.lit("")))


def enrich_reviews(reviews: DataFrame, products: DataFrame, order: str = "ord") -> DataFrame:
    """Reviews with title, brand and category of their product.

    The last of several products with one id counts; unknown products give
    the defaults.
    """
    last = first_per_key(
        products.select("product_id", order, F.col("title").alias("product_title"), "brand", "category"),
        ["product_id"], [F.desc(order)],
    ).drop(order)
    joined = reviews.join(last, "product_id", "left")
    return joined.fillna({"product_title": "", "brand": "Unknown", "category": "Electronics"})
