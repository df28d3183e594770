"""Processed tables to keyed tables and search indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift import schemas
from shelfsift.functions.normalize import embedding_text
from shelfsift.functions.stem import english_stem
from shelfsift.functions.text import ENGLISH_TEXT, PRODUCT
from shelfsift.operators import enrich, fuzzy, match, suggest, vectors
from shelfsift.operators.postings import TextIndex, save_positions, stem_table
from shelfsift.plans import autocomplete, search
from shelfsift.sources import jsonl
from shelfsift.sources.tables import TableStore, capped


def embed_products(products: DataFrame, model: Callable[[list[str]], list[list[float]]] | None = None,
                   dimensions: int = vectors.DIMENSIONS) -> DataFrame:
    """(doc_id, embedding) of title, features and description."""
    texts = products.select(
        "product_id", embedding_text(F.col("title"), F.col("features"), F.col("description")).alias("embedding_text")
    )
    if model is not None:
        return vectors.embed_column(texts, "product_id", "embedding_text", model)
    return vectors.dense(vectors.hashed_features(texts, "product_id", "embedding_text", dimensions), dimensions)


def load_tables(store: TableStore, products: DataFrame, reviews: DataFrame, order: str = "ord", limit: int = 0,
                reset: bool = False, take: Callable[[DataFrame, int], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Merge both tables in the relational and in the document way.

    Documents keep the last of several reviews with one id and test against
    all products read; the relational tables keep the first and test against
    the products of this load.
    """
    some_products, some_reviews = capped(products, reviews, limit, order, take)
    relational = _conformed(some_products, schemas.PRODUCT_SCHEMA, schemas.PRODUCT_DEFAULTS, order)
    known = enrich.of_known_products(some_reviews, some_products)
    rows = _conformed(known, schemas.REVIEW_SCHEMA, schemas.REVIEW_DEFAULTS, order)
    documents = schemas.document_store_projection(some_products)
    of_any = enrich.of_known_products(some_reviews, products)
    return {
        "products": store.load("products", relational, "product_id", order, reset=reset),
        "reviews": store.load("reviews", rows, "review_id", order, reset=reset, keep="first"),
        "product_documents": store.load("product_documents", documents, "product_id", order, reset=reset),
        "review_documents": store.load("review_documents", of_any, "review_id", order, reset=reset),
    }


def _conformed(df: DataFrame, schema, defaults: dict, order: str) -> DataFrame:
    """Schema and defaults enforced, the order column carried along."""
    full = schema.__class__(schema.fields + [df.schema[order]])
    return schemas.conform(df, full, defaults)


def build_indexes(store: TableStore, products: DataFrame, reviews: DataFrame,
                  model: Callable[[list[str]], list[list[float]]] | None = None, embeddings: bool = True) -> None:
    """Write what searches read: postings, statistics, weighted positions and vectors."""
    keys = fuzzy.deletion_index
    search.product_index(products).save(f"{store.root}/product_index", keys)
    search.product_index(products, exact_attributes=True).save(f"{store.root}/exact_product_index", keys)
    autocomplete.title_index(products).save(f"{store.root}/title_index")
    search.review_index(reviews).save(f"{store.root}/review_index", keys)
    search.review_index(reviews, PRODUCT).save(f"{store.root}/plain_review_index", keys)
    for name, rows, classes, key in (
        ("product", products, match.PRODUCT_CLASSES, "product_id"), ("review", reviews, match.REVIEW_CLASSES, "review_id"),
    ):
        path = f"{store.root}/{name}_positions"
        save_positions(search.class_positions(rows, classes, key, ENGLISH_TEXT), path)
        words = stem_table(store.spark.read.parquet(path), english_stem)
        words.write.mode("overwrite").parquet(f"{store.root}/{name}_words")
    if embeddings:
        store.write("product_vectors", embed_products(products, model))


def stored_index(store: TableStore, products: DataFrame, reviews: DataFrame) -> search.SearchIndex:
    """The written postings, for searches that should not analyse the texts again."""
    spark = store.spark
    read = lambda name, fields: TextIndex.load(spark, f"{store.root}/{name}", fields, keys=True)
    return search.SearchIndex(
        products=read("product_index", search.product_fields(products)),
        reviews=read("review_index", search.review_fields()),
        exact_products=read("exact_product_index", search.product_fields(products, exact_attributes=True)),
        plain_reviews=read("plain_review_index", search.review_fields(PRODUCT)),
        product_positions=spark.read.parquet(f"{store.root}/product_positions"),
        review_positions=spark.read.parquet(f"{store.root}/review_positions"),
        titles=TextIndex.load(spark, f"{store.root}/title_index", suggest.suggest_fields()),
        product_words=spark.read.parquet(f"{store.root}/product_words"),
        review_words=spark.read.parquet(f"{store.root}/review_words"),
    )


def run(spark: SparkSession, processed: str, store_path: str, limit: int = 0, reset: bool = False,
        model: Callable[[list[str]], list[list[float]]] | None = None, embeddings: bool = True,
        indexes: bool = True) -> dict[str, DataFrame]:
    """Load the processed folder in file order."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("line"),
    ).alias("ord")
    read = lambda name, schema: jsonl.read_processed(spark, f"{processed}/{name}", schema).select("*", place)
    tables = load_tables(
        TableStore(spark, store_path), read("products", schemas.ENRICHED_PRODUCT_SCHEMA),
        read("reviews", schemas.ENRICHED_REVIEW_SCHEMA), limit=limit, reset=reset, take=jsonl.first_in_file_order,
    )
    if indexes:
        build_indexes(TableStore(spark, store_path), tables["product_documents"], tables["review_documents"], model, embeddings)
    return tables
