"""Per-product review aggregates, load counters and order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsift.operators.facets import half_even
from shelfsift.operators.limits import dealt, first_per_key

TEXTS_PER_PRODUCT = 5


def review_aggregates(reviews: DataFrame, order: str = "ord") -> DataFrame:
    """Count, mean rating, votes and the first five non-empty texts of each product.

    The texts are ranked with a capped window before they are gathered, so a
    product with any number of reviews moves five of them.
    """
    numbers = reviews.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("loaded_review_count"),
        half_even(F.sum("rating") / F.count(F.lit(1))).alias("avg_review_rating"),
        F.sum(F.col("helpful_vote").cast("long")).alias("helpful_votes"),
    )
    kept = first_per_key(
        reviews.filter(F.col("text") != "").select("product_id", order, "text"),
        ["product_id"], [F.asc(order)], TEXTS_PER_PRODUCT,
    )
    texts = kept.groupBy("product_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda s: s["text"]), " "
        ).alias("review_text")
    )
    return numbers.join(texts, "product_id", "left").fillna("", ["review_text"])


def load_counters(normalized: DataFrame, product_ids: DataFrame, scanned: DataFrame,
                  cap: int | None) -> DataFrame:
    """What a review load saw, kept and skipped, as one row.

    The reviews are counted per product first; what is joined and capped after
    that are the counts.
    """
    known = product_ids.select("product_id").distinct().withColumn("_known", F.lit(True))
    per_product = normalized.groupBy("product_id").agg(F.count(F.lit(1)).alias("_n")).join(known, "product_id", "left")
    matched = F.when(F.col("_known"), F.col("_n")).otherwise(0)
    kept = F.least(matched, F.lit(cap).cast("long")) if cap else matched
    zero = F.lit(0).cast("long")
    return per_product.agg(
        scanned.select(F.count(F.lit(1))).scalar().alias("scanned"),
        F.coalesce(F.sum("_n"), zero).alias("normalized"),
        F.coalesce(F.sum(matched), zero).alias("matched_products"),
        F.coalesce(F.sum(kept), zero).alias("accepted"),
        F.coalesce(F.sum(matched - kept), zero).alias("skipped_per_product_cap"),
        F.count("_known").alias("products_with_reviews"),
    )


def latency_stats(df: DataFrame, value: str, by: list[str], quantile: float = 0.95) -> DataFrame:
    """Count, mean, nearest-rank quantile, minimum and maximum per group.

    The quantile is exact. Equal values are counted first; the distinct ones are dealt out by ranges of group and value,
    so a group of any size is spread over ranges, outliers or not. Sums per group and range lead to
    the range that holds the wanted rank.
    """
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    basic = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), half_even(F.sum("_x") / F.count(F.lit(1))).alias("avg_ms"),
        F.min("_x").alias("min_ms"), F.max("_x").alias("max_ms"),
    ).withColumn("_at", F.rint((F.col("count") - 1) * quantile).cast("long"))
    placed = dealt(rows.groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_c")), *by, "_x")
    sizes = placed.groupBy(*by, "_part").agg(F.sum("_c").alias("_c"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    holder = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(earlier), F.lit(0))).join(basic.select(*by, "_at"), by).filter(
        (F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_c"))
    ).select(*by, "_part", "_before", "_at")
    running = W.partitionBy(*by, "_part").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    quantiles = placed.join(holder, [*by, "_part"]).withColumn("_upto", F.col("_before") + F.sum("_c").over(running)).filter(
        F.col("_at") < F.col("_upto")
    ).groupBy(*by).agg(F.min("_x").alias("p95_ms"))
    return basic.join(quantiles, by).select(*by, "count", "avg_ms", "p95_ms", "min_ms", "max_ms")
