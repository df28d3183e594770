"""Raw lines to processed product and review tables with a manifest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from shelfsift.functions.normalize import normalize_products, normalize_reviews
from shelfsift.operators import enrich
from shelfsift.operators.review_stats import load_counters, review_aggregates
from shelfsift.operators.sizes import materialized
from shelfsift.sources import jsonl
from shelfsift.sources.tables import manifest_row


@dataclass(frozen=True)
class Prepared:
    products: DataFrame
    reviews: DataFrame
    counters: DataFrame


def accepted_products(lines: DataFrame, limit: int | None) -> DataFrame:
    """The first valid products in file order; a limit below one still takes one."""
    valid = normalize_products(lines)
    return jsonl.first_in_file_order(valid, None if limit is None else max(limit, 1))


def prepare(product_lines: DataFrame, review_lines: DataFrame, product_limit: int | None = None,
            reviews_per_product: int | None = None, keep: bool = False) -> Prepared:
    """Normalise, select, aggregate and enrich; everything is taken unless the caller sets a limit.

    ``keep`` writes the selected rows to the shared folder, so that the raw
    lines are decoded once although several tables come from them.
    """
    kept = materialized if keep else lambda df: df
    products = kept(accepted_products(product_lines, product_limit))
    normalized = normalize_reviews(review_lines)
    reviews = kept(enrich.cap_per_product(enrich.of_known_products(normalized, products), reviews_per_product))
    full_products = enrich.enrich_products(products, review_aggregates(reviews))
    full_reviews = enrich.enrich_reviews(reviews, products)
    counters = kept(load_counters(normalized, products, review_lines, reviews_per_product))
    return Prepared(full_products, full_reviews, counters)


def run(spark: SparkSession, product_path: str, review_path: str, output: str,
        product_limit: int | None = None, reviews_per_product: int | None = None) -> dict:
    """Read, prepare and write both tables, the counters and the manifest; returns the row counts."""
    has_reviews = jsonl.path_exists(spark, review_path)
    reviews = jsonl.read_json_lines(spark, review_path) if has_reviews else jsonl.no_lines(spark)
    ready = prepare(jsonl.read_json_lines(spark, product_path), reviews, product_limit, reviews_per_product, keep=True)
    counts = {
        "product_count": jsonl.write_json_lines(ready.products.drop("ord"), f"{output}/products"),
        "review_count": jsonl.write_json_lines(ready.reviews.drop("ord"), f"{output}/reviews"),
    }
    ready.counters.coalesce(1).write.mode("overwrite").json(f"{output}/counters")
    manifest_row(
        spark, product_source=product_path, review_source=review_path if has_reviews else None,
        product_limit=product_limit, max_reviews_per_product=reviews_per_product or None,
        products_file="products", reviews_file="reviews", **counts,
    ).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{output}/manifest")
    return counts
