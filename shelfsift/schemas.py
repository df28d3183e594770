"""Fixed schemas of the normalised tables, with their column defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names and types of the columns.
PRODUCT_SCHEMA = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("features", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("average_rating", T.DoubleType()),
    T.StructField("rating_number", T.LongType()),
    T.StructField("avg_review_rating", T.DoubleType()),
    T.StructField("loaded_review_count", T.LongType()),
    T.StructField("helpful_votes", T.LongType()),
    T.StructField("review_text", T.StringType()),
])

REVIEW_SCHEMA = T.StructType([
    T.StructField("review_id", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("helpful_vote", T.LongType()),
    T.StructField("verified_purchase", T.BooleanType()),
    T.StructField("timestamp", T.LongType()),
])

# What the enriched files hold beyond the keyed tables.
ENRICHED_PRODUCT_SCHEMA = T.StructType(
    PRODUCT_SCHEMA.fields + [T.StructField("title_suggest", T.StringType())]
)
ENRICHED_REVIEW_SCHEMA = T.StructType(
    REVIEW_SCHEMA.fields
    + [T.StructField(name, T.StringType()) for name in ("product_title", "brand", "category")]
)

PRODUCT_COLUMNS = PRODUCT_SCHEMA.fieldNames()
REVIEW_COLUMNS = REVIEW_SCHEMA.fieldNames()

# Defaults of the stored columns. A column not listed stays null.
PRODUCT_DEFAULTS = {
    "features": "",
    "description": "",
    "category": "Electronics",
    "brand": "Unknown",
    "rating": 0.0,
    "review_count": 0,
    "average_rating": 0.0,
    "rating_number": 0,
    "avg_review_rating": 0.0,
    "loaded_review_count": 0,
    "helpful_votes": 0,
    "review_text": "",
}
REVIEW_DEFAULTS = {
    "user_id": "anonymous",
    "rating": 0.0,
    "title": "",
    "text": "",
    "helpful_vote": 0,
    "verified_purchase": False,
}

# Attribute roles of the two document collections.
PRODUCT_FILTERABLE = ["brand", "category", "price", "rating", "average_rating"]
PRODUCT_SORTABLE = ["price", "rating", "review_count", "average_rating", "rating_number"]
PRODUCT_SEARCHABLE = ["title", "brand", "category", "features", "description", "review_text"]
REVIEW_FILTERABLE = ["product_id", "brand", "category", "rating", "verified_purchase"]
REVIEW_SORTABLE = ["rating", "helpful_vote"]
REVIEW_SEARCHABLE = ["title", "text"]


def conform(df: DataFrame, schema: T.StructType, defaults: dict) -> DataFrame:
    """Select exactly ``schema``: cast each column, fill nulls and absent columns with the default."""
    have = set(df.columns)
    out = []
    for field in schema.fields:
        value = F.col(field.name) if field.name in have else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        out.append(value.alias(field.name))
    return df.select(*out)


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns one store takes, in its order; columns the table lacks come out null."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in columns])


def document_store_projection(df: DataFrame) -> DataFrame:
    """Drop the helper columns a document store does not take."""
    return df.drop("semantic_text", "title_suggest")
