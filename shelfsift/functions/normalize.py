"""Raw product and review lines to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.functions import coerce as C

_PRODUCT_KEYS = [
    "product_id", "parent_asin", "asin", "title", "categories", "details", "features",
    "description", "average_rating", "rating", "rating_number", "review_count", "category",
    "main_category", "brand", "store", "price",
]
_REVIEW_KEYS = [
    "product_id", "parent_asin", "asin", "user_id", "reviewerID", "timestamp", "title", "summary",
    "text", "reviewText", "review_id", "id", "rating", "overall", "helpful_vote",
    "verified_purchase", "verified",
]


def _decode(raw: DataFrame, keys: list[str]) -> tuple[DataFrame, dict[str, C.Field]]:
    """Decode each line once into its fields; malformed JSON fails the job.

    The kinds of the keys that a line has are read in one pass, not searched for key by key.
    """
    decoded = raw.select(
        "ord",
        F.parse_json("value").alias("_v"),
        F.from_json("value", "map<string,string>").alias("_texts"),
    ).withColumn("_kinds", C.kinds_of(F.col("_v")))
    return C.stage(decoded, {key: C.known_field(F.col("_kinds"), F.col("_texts"), key) for key in keys})


def _or_else(*fields: C.Field, default: str) -> Column:
    """Text of the first true field, else a default."""
    tested = [F.when(C.truthy(f), C.scalar_text(f)) for f in fields]
    return F.coalesce(*tested, F.lit(default))


def _last_item(field: C.Field) -> C.Field:
    """Last list element; missing when the list is empty or absent."""
    is_list = field.kind == "ARRAY"
    kinds = F.parse_json(F.when(is_list, field.text)).try_cast("array<variant>")
    return C.Field(
        F.when(is_list, C.kind_of(F.try_element_at(kinds, F.lit(-1)))),
        F.when(is_list, F.try_element_at(F.from_json(field.text, "array<string>"), F.lit(-1))),
    )


def normalize_products(raw: DataFrame) -> DataFrame:
    """(ord, value) JSON lines to product rows; rows without id or title are rejected.

    Values used more than once are staged as columns, which keeps the plan
    small: the optimizer does not repeat an expensive expression it can refer to.
    """
    rows, f = _decode(raw, _PRODUCT_KEYS)
    rows, more = C.stage(rows, {
        "id": C.first_truthy(f["product_id"], f["parent_asin"], f["asin"]),
        "stars": C.first_truthy(f["average_rating"], f["rating"]),
        "votes": C.first_truthy(f["rating_number"], f["review_count"]),
        "last_category": _last_item(f["categories"]),
    })
    f.update(more)
    details = F.variant_get("_v", "$.details", "variant")
    detail_texts = F.from_json(f["details"].text, "map<string,string>")
    rows, more = C.stage(
        rows.filter(C.truthy(f["id"]) & C.truthy(f["title"])),
        {f"detail_{key}": C.raw_field(details, detail_texts, key) for key in ("Brand", "Manufacturer")},
    )
    f.update(more)
    rows = rows.withColumns({
        "_title": C.scalar_text(f["title"]),
        "_features": C.as_text(f["features"]),
        "_described": C.as_text(f["description"]),
        "_stars": C.parse_number(f["stars"]),
        "_votes": C.parse_count(f["votes"]),
    })
    joined = F.concat_ws(" ", F.nullif("_described", F.lit("")), F.nullif("_features", F.lit("")))
    return rows.select(
        "ord",
        C.scalar_text(f["id"]).alias("product_id"),
        F.col("_title").alias("title"),
        F.col("_features").alias("features"),
        C.first_nonempty(joined, F.col("_title")).alias("description"),
        _or_else(f["category"], f["last_category"], f["main_category"], default="Electronics").alias("category"),
        _or_else(f["brand"], f["store"], f["detail_Brand"], f["detail_Manufacturer"], default="Unknown").alias("brand"),
        C.parse_number(f["price"]).alias("price"),
        F.col("_stars").alias("rating"),
        F.col("_votes").alias("review_count"),
        F.col("_stars").alias("average_rating"),
        F.col("_votes").alias("rating_number"),
    )


def content_key(product: Column, user: Column, stamp: Column, text: Column) -> Column:
    """SHA-1 of the identifying parts and the first 80 characters of the text."""
    return F.sha1(
        F.concat_ws(":", product, user, F.coalesce(stamp, F.lit("")),
                    F.substring(F.coalesce(text, F.lit("")), 1, 80))
    )


def normalize_reviews(raw: DataFrame) -> DataFrame:
    """(ord, value) JSON lines to review rows; rows without a product id are rejected.

    A text that is present but null counts as ''.
    """
    rows, f = _decode(raw, _REVIEW_KEYS)
    given = F.map_contains_key("_texts", F.lit("verified_purchase"))
    flag, alias = f["verified_purchase"], f["verified"]
    rows, more = C.stage(rows, {
        "product": C.first_truthy(f["parent_asin"], f["asin"], f["product_id"]),
        "stars": C.first_truthy(f["rating"], f["overall"]),
        "headline": C.first_truthy(f["title"], f["summary"]),
        "body": C.first_truthy(f["text"], f["reviewText"]),
        "bought": C.Field(
            F.when(given, flag.kind).otherwise(alias.kind), F.when(given, flag.text).otherwise(alias.text)
        ),
    })
    f.update(more)
    stamp = f["timestamp"]
    # An absent title is '', one that is null prints as None.
    title_part = F.when(~F.map_contains_key("_texts", F.lit("title")), "").otherwise(
        F.coalesce(C.scalar_text(f["title"]), F.lit("None"))
    )
    rows = rows.filter(C.truthy(f["product"])).withColumns({
        "_product": C.scalar_text(f["product"]),
        "_user": _or_else(f["user_id"], f["reviewerID"], default="anonymous"),
        "_given": F.coalesce(*[F.when(C.truthy(f[k]), C.scalar_text(f[k])) for k in ("review_id", "id")]),
        "_stamp": F.when(C.truthy(stamp), C.scalar_text(stamp)),
    })
    generated = content_key(
        F.col("_product"), F.col("_user"), F.coalesce("_stamp", title_part), C.scalar_text(f["text"])
    )
    return rows.select(
        "ord",
        F.coalesce("_given", generated).alias("review_id"),
        F.col("_product").alias("product_id"),
        F.col("_user").alias("user_id"),
        C.parse_number(f["stars"]).alias("rating"),
        C.as_text(f["headline"]).alias("title"),
        C.as_text(f["body"]).alias("text"),
        C.parse_count(f["helpful_vote"]).alias("helpful_vote"),
        C.parse_bool(f["bought"]).alias("verified_purchase"),
        C.digits_to_long(F.col("_stamp")).alias("timestamp"),
    )


def embedding_text(title: Column, features: Column, description: Column) -> Column:
    """Title plus the first 200 characters of features and of description."""
    clip = lambda c: F.substring(F.nullif(c, F.lit("")), 1, 200)
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), clip(features), clip(description))
