"""Product- and review-shaped views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.operators import enrich, review_stats


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def products(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.lower("p_type")
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("title"),
        kind.alias("features"),
        F.concat("p_name", F.lit(" "), kind).alias("description"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("brand"),
        (F.col("p_partkey") % 400).cast("double").alias("price"),
        (1 + F.col("p_size") % 5).cast("double").alias("rating"),
        (F.col("p_size") * 10).cast("int").alias("review_count"),
    )


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels, told to be one per document where a count says so: a join that only readers of ratings need then drops out
    for all others, and their texts aren't shuffled. Else they are joined as they are."""
    labels = table(spark, folder, "labels")
    if not labels.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return labels
    return labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    labels = _labels(spark, folder)
    rating = (
        F.when(F.col("quality") == 0, 1.0)
        .when(F.col("toxic") == 1, 2.0)
        .otherwise((1 + F.col("doc_id") % 5).cast("double"))
    )
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("review_id"),
        (F.col("doc_id") % 150).cast("string").alias("product_id"),
        F.col("source").alias("user_id"),
        rating.alias("rating"),
        F.substring("text", 1, 40).alias("title"),
        "text",
        (F.col("n_chars") % 100).cast("int").alias("helpful_vote"),
        (F.col("doc_id") % 2 == 0).alias("verified_purchase"),
        (1700000000 + F.col("doc_id") * 100).alias("timestamp"),
        "lang",
        F.col("doc_id").alias("ord"),
    )


def enriched_products(spark: SparkSession, folder: str) -> DataFrame:
    """Products with the texts of their first reviews, the sixth field that searches read."""
    return enrich.enrich_products(products(spark, folder), review_stats.review_aggregates(reviews(spark, folder)))


PRODUCTS_SQL = """
v_products AS (
  SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS title, lower(p_type) AS features,
         concat(p_name, ' ', lower(p_type)) AS description, p_type AS category, p_brand AS brand,
         CAST(p_partkey % 400 AS DOUBLE) AS price, CAST(1 + p_size % 5 AS DOUBLE) AS rating,
         CAST(p_size * 10 AS INT) AS review_count
  FROM part)"""

REVIEWS_SQL = """
v_reviews AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS review_id, CAST(d.doc_id % 150 AS VARCHAR) AS product_id,
         d.source AS user_id,
         CASE WHEN l.quality = 0 THEN CAST(1 AS DOUBLE) WHEN l.toxic = 1 THEN CAST(2 AS DOUBLE)
              ELSE CAST(1 + d.doc_id % 5 AS DOUBLE) END AS rating,
         substring(d.text, 1, 40) AS title, d.text AS text,
         CAST(d.n_chars % 100 AS INT) AS helpful_vote, (d.doc_id % 2 = 0) AS verified_purchase,
         1700000000 + d.doc_id * 100 AS timestamp, d.lang AS lang, d.doc_id AS ord
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

# After the two views above: products with the texts of their first five reviews that have any.
ENRICHED_SQL = """
v_enriched AS (
  SELECT p.*, coalesce(t.review_text, '') AS review_text FROM v_products p LEFT JOIN (
    SELECT product_id, string_agg(text, ' ' ORDER BY ord) AS review_text FROM (
      SELECT * FROM v_reviews WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY ord) <= 5) GROUP BY 1) t
  ON t.product_id = p.product_id)"""
