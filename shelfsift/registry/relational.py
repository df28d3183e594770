"""Joins, windows, limits and set operations (D1-D4, W, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsift.operators import enrich, limits
from shelfsift.registry import register
from shelfsift.schemas import REVIEW_SORTABLE
from shelfsift.sources import tables, views
from shelfsift.sources.views import PRODUCTS_SQL, REVIEWS_SQL, table


@register("d01_reviews_join_products", f"""
    WITH {PRODUCTS_SQL}, {REVIEWS_SQL}
    SELECT r.review_id, r.product_id, r.rating, p.title AS product_title, p.brand, p.category
    FROM v_reviews r JOIN v_products p ON p.product_id = r.product_id""")
def reviews_join_products(spark, folder):
    reviews = views.reviews(spark, folder).select("review_id", "product_id", "rating")
    return enrich.join_products(reviews, views.products(spark, folder))


@register("d02_known_products_only", """
    SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')""")
def known_products_only(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("product_id"))
    chosen = table(spark, folder, "part").filter("p_type = 'ECONOMY'").select(F.col("p_partkey").alias("product_id"))
    return enrich.of_known_products(lines, chosen).withColumnRenamed("product_id", "l_partkey")


@register("d03_enrich_products", f"""
    WITH {PRODUCTS_SQL}, {REVIEWS_SQL}, agg AS (
      SELECT product_id, count(*) AS loaded_review_count, round_even(sum(rating) / count(*), 2) AS avg_review_rating,
             CAST(sum(helpful_vote) AS BIGINT) AS helpful_votes
      FROM v_reviews GROUP BY 1),
    texts AS (
      SELECT product_id, string_agg(text, ' ' ORDER BY ord) AS review_text FROM (
        SELECT product_id, ord, text FROM v_reviews WHERE text <> ''
        QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY ord) <= 5) GROUP BY 1)
    SELECT p.product_id, p.title, p.brand, coalesce(a.loaded_review_count, 0) AS loaded_review_count,
           coalesce(a.avg_review_rating, 0) AS avg_review_rating, coalesce(a.helpful_votes, 0) AS helpful_votes,
           coalesce(t.review_text, '') AS review_text, p.title AS title_suggest
    FROM v_products p LEFT JOIN agg a ON a.product_id = p.product_id LEFT JOIN texts t ON t.product_id = p.product_id""")
def enrich_products(spark, folder):
    from shelfsift.operators.review_stats import review_aggregates

    products = views.products(spark, folder).select("product_id", "title", "brand")
    return enrich.enrich_products(products, review_aggregates(views.reviews(spark, folder)))


@register("d04_enrich_reviews", f"""
    WITH {PRODUCTS_SQL}, {REVIEWS_SQL}, copies AS (
      SELECT product_id, title, brand, category, 1 AS ord FROM v_products WHERE rating > 1
      UNION ALL SELECT product_id, title || ' (new)', brand, category, 2 FROM v_products WHERE rating > 3),
    last AS (SELECT * FROM copies QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY ord DESC) = 1)
    SELECT r.review_id, r.product_id, coalesce(l.title, '') AS product_title, coalesce(l.brand, 'Unknown') AS brand,
           coalesce(l.category, 'Electronics') AS category
    FROM v_reviews r LEFT JOIN last l ON l.product_id = r.product_id""")
def enrich_reviews(spark, folder):
    """Some products are missing and some come twice; the later copy counts."""
    p = views.products(spark, folder).select("product_id", "title", "brand", "category", "rating")
    copies = p.filter("rating > 1").withColumn("ord", F.lit(1)).unionByName(
        p.filter("rating > 3").withColumn("title", F.concat("title", F.lit(" (new)"))).withColumn("ord", F.lit(2))
    )
    return enrich.enrich_reviews(views.reviews(spark, folder).select("review_id", "product_id"), copies)


@register("w01_match_count_per_group", """
    SELECT lang, doc_id, n_chars, total FROM (
      SELECT lang, doc_id, n_chars, count(*) OVER (PARTITION BY lang) AS total,
             row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents)
    WHERE rank <= 10""")
def match_count_per_group(spark, folder):
    """The total of a group next to its first page, without moving the group to one task."""
    docs = table(spark, folder, "documents").select("lang", "doc_id", "n_chars")
    return limits.page_with_total(docs, 10, [F.desc("n_chars"), F.asc("doc_id")], "lang").drop("rank")


@register("w02_cap_per_key", """
    SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) <= 5""")
def cap_per_key(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    order = [F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]
    return limits.first_per_key(lines, ["l_partkey"], order, 5).drop("l_extendedprice")


@register("w03_keep_first_and_last", """
    SELECT 'last' AS kept, user_id, event_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1
    UNION ALL SELECT * FROM (SELECT 'first', user_id, event_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)""")
def keep_first_and_last(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    last = tables.keep_last(events, ["user_id"], "event_id").withColumn("kept", F.lit("last"))
    return last.unionByName(tables.keep_first(events, ["user_id"], "event_id").withColumn("kept", F.lit("first")))


@register("w04_top_k_per_query", """
    SELECT lang AS query_id, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank
    FROM documents QUALIFY rank <= 10""")
def top_k_per_query(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("lang").alias("query_id"), "doc_id", "n_chars")
    return limits.top_k(docs, 10, [F.desc("n_chars"), F.asc("doc_id")]).withColumn("rank", F.col("rank").cast("long"))


@register("k01_order_rating_review_count", f"""
    WITH {PRODUCTS_SQL} SELECT product_id, price AS score, rating, review_count FROM v_products
    ORDER BY score DESC, rating DESC, review_count DESC, product_id LIMIT 10""")
def order_rating_review_count(spark, folder):
    rows = views.products(spark, folder).select("product_id", F.col("price").alias("score"), "rating", "review_count")
    return rows.orderBy(F.desc("score"), F.desc("rating"), F.desc("review_count"), "product_id").limit(10)


@register("k02_order_average_rating", f"""
    WITH {PRODUCTS_SQL} SELECT product_id, length(title) AS score, rating AS average_rating, review_count AS rating_number FROM v_products
    ORDER BY score DESC, average_rating DESC, rating_number DESC, product_id LIMIT 50""")
def order_average_rating(spark, folder):
    rows = views.products(spark, folder).select(
        "product_id", F.length("title").alias("score"), F.col("rating").alias("average_rating"),
        F.col("review_count").alias("rating_number"),
    )
    return rows.orderBy(F.desc("score"), F.desc("average_rating"), F.desc("rating_number"), "product_id").limit(50)


@register("k03_order_helpful_vote", f"""
    WITH {REVIEWS_SQL} SELECT review_id, rating AS score, helpful_vote FROM v_reviews
    ORDER BY score DESC, helpful_vote DESC, review_id LIMIT 10""")
def order_helpful_vote(spark, folder):
    rows = views.reviews(spark, folder).select("review_id", F.col("rating").alias("score"), "helpful_vote")
    return rows.orderBy(F.desc("score"), F.desc("helpful_vote"), "review_id").limit(10)


@register("k04_allowed_sort", f"""
    WITH {REVIEWS_SQL} SELECT lang AS query_id, review_id, helpful_vote FROM v_reviews
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY helpful_vote DESC, review_id) <= 10""")
def allowed_sort(spark, folder):
    """Sorting by an attribute the collection declares sortable."""
    rows = views.reviews(spark, folder).select(F.col("lang").alias("query_id"), "review_id", "helpful_vote")
    order = [limits.sort_column("helpful_vote", REVIEW_SORTABLE), F.asc("review_id")]
    return limits.top_k(rows, 10, order).drop("rank")


@register("k05_page_and_size", f"""
    WITH {PRODUCTS_SQL} SELECT product_id, price FROM v_products ORDER BY price DESC, product_id LIMIT 20 OFFSET 40""")
def page_and_size(spark, folder):
    rows = views.products(spark, folder).select("product_id", "price")
    return limits.page_of(rows, [F.desc("price"), F.asc("product_id")], 3, 20)


@register("k06_page_through_all", """
    SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS page FROM orders""")
def page_through_all(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return limits.pages(orders, "o_orderkey", 1000).drop("row_no")


@register("k07_first_valid_rows", """
    SELECT p_partkey, p_name FROM part WHERE p_size <> 7 ORDER BY p_partkey LIMIT 1500""")
def first_valid_rows(spark, folder):
    """The limit counts accepted rows only."""
    valid = table(spark, folder, "part").filter("p_size <> 7").select("p_partkey", "p_name")
    return limits.first_n(valid, 1500, "p_partkey")


@register("k08_total_cap", """
    SELECT l_returnflag AS query_id, least(count(*), 100000) AS total FROM lineitem GROUP BY 1""")
def total_cap(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("query_id"))
    return limits.match_totals(lines, cap=100_000)
