"""Aggregations, facets and statistics (G), ordered distinct (U2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsift.operators import enrich, facets, review_stats
from shelfsift.registry import register
from shelfsift.sources import views
from shelfsift.sources.views import PRODUCTS_SQL, REVIEWS_SQL, table

# SQL rounding on the decimal value, the way SQL numerics round.
_AVG = "CAST(round(CAST(avg(rating) AS DECIMAL(30, 12)), 2) AS DOUBLE)"
_EVEN = "round_even(avg(rating), 2)"


def _tagged(spark, folder):
    """All reviews with their product's brand and category, grouped by language as the query."""
    joined = enrich.join_products(views.reviews(spark, folder), views.products(spark, folder))
    return joined.withColumn("query_id", F.col("lang"))


_TAGGED_SQL = f"""{PRODUCTS_SQL}, {REVIEWS_SQL}, tagged AS (
  SELECT r.*, p.title AS product_title, p.brand, p.category, r.lang AS query_id
  FROM v_reviews r JOIN v_products p ON p.product_id = r.product_id)"""


@register("g01_terms_facet_matched", f"""
    WITH {PRODUCTS_SQL} SELECT brand AS value, count(*) AS n FROM v_products
    WHERE price >= 100 AND regexp_matches(title, '(^|[^a-z])red([^a-z]|$)') GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
def terms_facet_matched(spark, folder):
    """Top brands of the rows that match the text and pass the filter."""
    from shelfsift.functions.text import PRODUCT

    matched = views.products(spark, folder).filter(
        (F.col("price") >= 100) & F.array_contains(PRODUCT.tokens(F.col("title")), "red")
    )
    return facets.terms_facet(matched, "brand")


@register("g02_terms_facet_filtered", f"""
    WITH {PRODUCTS_SQL} SELECT brand AS value, count(*) AS n FROM v_products
    WHERE price >= 100 GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
def terms_facet_filtered(spark, folder):
    """Top brands of the filtered rows; the text match does not count."""
    return facets.terms_facet(views.products(spark, folder).filter("price >= 100"), "brand")


@register("g03_facet_distribution", f"""
    WITH {PRODUCTS_SQL} SELECT category, value, n FROM (
      SELECT category, brand AS value, count(*) AS n FROM v_products GROUP BY 1, 2)""")
def facet_distribution(spark, folder):
    """All brand counts per category, through the map form."""
    maps = facets.distribution_map(views.products(spark, folder), "brand", ["category"])
    return maps.select("category", F.explode("distribution").alias("value", "n"))


@register("g04_price_buckets", """
    SELECT b.value, b.low, b.high, count(p.x) AS n
    FROM (VALUES ('*-50.0', CAST(NULL AS DOUBLE), CAST(50 AS DOUBLE)), ('50.0-100.0', 50, 100), ('100.0-300.0', 100, 300),
                 ('300.0-*', 300, NULL)) b(value, low, high)
    LEFT JOIN (SELECT p_retailprice / 10 AS x FROM part) p
      ON (b.low IS NULL OR p.x >= b.low) AND (b.high IS NULL OR p.x < b.high)
    GROUP BY 1, 2, 3""")
def price_buckets(spark, folder):
    scaled = table(spark, folder, "part").select((F.col("p_retailprice") / 10).alias("price"))
    return facets.range_buckets(scaled, "price")


@register("g05_histogram", """
    WITH c AS (SELECT l_returnflag AS query_id, floor(l_extendedprice / 1000) AS s, count(*) AS n FROM lineitem GROUP BY 1, 2),
    every AS (SELECT query_id, unnest(generate_series(CAST(min(s) AS BIGINT), CAST(max(s) AS BIGINT))) AS s FROM c GROUP BY 1)
    SELECT e.query_id, CAST(e.s * 1000 AS DOUBLE) AS value, coalesce(c.n, 0) AS n
    FROM every e LEFT JOIN c ON c.query_id = e.query_id AND c.s = e.s""")
def histogram(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("query_id"), "l_extendedprice")
    return facets.histogram(lines, "l_extendedprice", 1000, ["query_id"])


@register("g06_value_distribution", f"""
    WITH {REVIEWS_SQL} SELECT rating AS value, count(*) AS n FROM v_reviews GROUP BY 1 ORDER BY 1""")
def value_distribution(spark, folder):
    return facets.value_counts(views.reviews(spark, folder), "rating").orderBy("value")


@register("g07_brand_metrics", f"""
    WITH {_TAGGED_SQL} SELECT brand AS value, count(*) AS negative_review_count, {_AVG} AS avg_rating,
           CAST(coalesce(sum(helpful_vote), 0) AS BIGINT) AS total_helpful_votes
    FROM tagged GROUP BY 1 ORDER BY 2 DESC, 3, 1 LIMIT 10""")
def brand_metrics(spark, folder):
    return facets.brand_metrics(_tagged(spark, folder))


@register("g08_category_counts", f"""
    WITH {_TAGGED_SQL} SELECT query_id, value, negative_review_count FROM (
      SELECT query_id, category AS value, count(*) AS negative_review_count FROM tagged GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY negative_review_count DESC, value) <= 10""")
def category_counts(spark, folder):
    return facets.category_counts(_tagged(spark, folder), ["query_id"])


@register("g09_match_summary", f"""
    WITH {REVIEWS_SQL}
    SELECT 'sql' AS dialect, count(*) AS matched_negative_reviews, {_AVG} AS avg_rating FROM v_reviews
    UNION ALL SELECT 'none', count(*), coalesce({_EVEN}, 0) FROM v_reviews WHERE rating > 9
    UNION ALL SELECT 'null', count(*), {_AVG} FROM v_reviews WHERE rating > 9""")
def match_summary(spark, folder):
    """The average of no rows is 0 in one dialect and null in the other."""
    reviews = views.reviews(spark, folder)
    nothing = reviews.filter("rating > 9")
    rows = facets.summary(reviews).withColumn("dialect", F.lit("sql"))
    rows = rows.unionByName(facets.summary(nothing, rounding=facets.half_even, empty=0).withColumn("dialect", F.lit("none")))
    return rows.unionByName(facets.summary(nothing).withColumn("dialect", F.lit("null")))


@register("g10_analytics_bundle", f"""
    WITH {_TAGGED_SQL}, long AS (
      SELECT query_id, 'brand' AS facet, brand AS value, count(*) AS n, {_EVEN} AS avg_rating, CAST(sum(helpful_vote) AS BIGINT) AS helpful_votes
      FROM tagged GROUP BY 1, 3
      UNION ALL SELECT query_id, 'category', category, count(*), {_EVEN}, CAST(sum(helpful_vote) AS BIGINT) FROM tagged GROUP BY 1, 3
      UNION ALL SELECT query_id, 'summary', NULL, count(*), {_EVEN}, CAST(sum(helpful_vote) AS BIGINT) FROM tagged GROUP BY 1),
    every AS (SELECT query_id, unnest(generate_series(CAST(min(floor(rating)) AS INT), CAST(max(floor(rating)) AS INT))) AS b FROM tagged GROUP BY 1),
    hist AS (
      SELECT e.query_id, 'rating' AS facet, CAST(e.b AS VARCHAR) || '.0' AS value, count(t.rating) AS n, round_even(avg(t.rating), 2) AS avg_rating,
             CAST(coalesce(sum(t.helpful_vote), 0) AS BIGINT) AS helpful_votes
      FROM every e LEFT JOIN tagged t ON t.query_id = e.query_id AND floor(t.rating) = e.b GROUP BY e.query_id, e.b)
    SELECT * FROM long
    QUALIFY facet = 'summary' OR row_number() OVER (PARTITION BY query_id, facet ORDER BY n DESC,
      CASE WHEN facet = 'brand' THEN avg_rating END NULLS FIRST, value) <= 10
    UNION ALL SELECT * FROM hist""")
def analytics_bundle(spark, folder):
    """Ratings 1, 2, 4 and 5 only would leave a gap; every language is one query."""
    return facets.analytics_bundle(_tagged(spark, folder))


@register("g11_sampled_analytics", f"""
    WITH {_TAGGED_SQL}, sample AS (
      SELECT * FROM tagged QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY helpful_vote DESC, review_id) <= 100),
    counts AS (
      SELECT query_id, brand AS value, count(*) AS negative_review_count FROM tagged GROUP BY 1, 2
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY negative_review_count DESC, value) <= 10),
    metrics AS (SELECT query_id, brand AS value, {_EVEN} AS avg_rating, CAST(sum(helpful_vote) AS BIGINT) AS v FROM sample GROUP BY 1, 2)
    SELECT c.query_id, c.value, c.negative_review_count, m.avg_rating, coalesce(m.v, 0) AS total_helpful_votes,
           s.matched_negative_reviews, s.avg_all
    FROM counts c LEFT JOIN metrics m ON m.query_id = c.query_id AND m.value = c.value
    JOIN (SELECT t.query_id, count(*) AS matched_negative_reviews, any_value(a) AS avg_all FROM tagged t
          JOIN (SELECT query_id, {_EVEN} AS a FROM sample GROUP BY 1) x ON x.query_id = t.query_id GROUP BY 1) s
      ON s.query_id = c.query_id""")
def sampled_analytics(spark, folder):
    """Counts of all matches, averages and votes of the first 100 hits of each query."""
    from shelfsift.operators.limits import top_k

    matches = _tagged(spark, folder)
    sample = top_k(matches, 100, [F.desc("helpful_vote"), F.asc("review_id")])
    brands = facets.sampled_brand_metrics(matches, sample)
    whole = facets.sampled_summary(matches, sample).withColumnRenamed("avg_rating", "avg_all")
    return brands.join(whole, "query_id")


@register("g12_review_row_aggregates", f"""
    WITH {_TAGGED_SQL}, gaps AS (
      SELECT CASE WHEN ord % 3 > 0 THEN brand WHEN ord % 2 = 0 THEN '' END AS b, CASE WHEN ord % 4 > 0 THEN category END AS c,
             CASE WHEN ord % 5 > 0 THEN rating + 0.5 END AS r, CASE WHEN ord % 7 > 0 THEN helpful_vote END AS h FROM tagged),
    filled AS (SELECT coalesce(nullif(b, ''), 'Unknown') AS brand, coalesce(c, 'Electronics') AS category,
                      coalesce(r, 0) AS rating, coalesce(h, 0) AS helpful_vote FROM gaps)
    SELECT * FROM (SELECT 'brand' AS facet, brand AS value, count(*) AS negative_review_count, {_EVEN} AS avg_rating,
                   CAST(sum(helpful_vote) AS BIGINT) AS total_helpful_votes FROM filled GROUP BY 2 ORDER BY 3 DESC, 4, 2 LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'category', category, count(*), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT) FROM filled GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
    UNION ALL SELECT 'rating', CAST(CAST(floor(rating) AS INT) AS VARCHAR), count(*), NULL, NULL FROM filled GROUP BY 2""")
def review_row_aggregates(spark, folder):
    """Rows with missing brand, category, rating or votes."""
    o = F.col("ord")
    gaps = _tagged(spark, folder).select(
        F.when(o % 3 > 0, F.col("brand")).when(o % 2 == 0, "").alias("brand"),
        F.when(o % 4 > 0, F.col("category")).alias("category"),
        F.when(o % 5 > 0, F.col("rating") + 0.5).alias("rating"),
        F.when(o % 7 > 0, F.col("helpful_vote")).alias("helpful_vote"),
    )
    return facets.review_row_aggregates(gaps)


@register("g13_product_review_metrics", f"""
    WITH {PRODUCTS_SQL}, {REVIEWS_SQL}, agg AS (
      SELECT product_id, count(*) AS c, round_even(sum(rating) / count(*), 2) AS a, sum(helpful_vote) AS h FROM v_reviews GROUP BY 1)
    SELECT round_even(avg(coalesce(a, 0)), 2) AS avg_rating, CAST(sum(coalesce(c, 0)) AS BIGINT) AS review_count,
           CAST(sum(coalesce(h, 0)) AS BIGINT) AS helpful_votes
    FROM v_products p LEFT JOIN agg ON agg.product_id = p.product_id""")
def product_review_metrics(spark, folder):
    """Mean over products, those without reviews included."""
    products = views.products(spark, folder).select("product_id", "title")
    aggregates = review_stats.review_aggregates(views.reviews(spark, folder))
    return facets.product_review_metrics(enrich.enrich_products(products, aggregates))


@register("g14_review_metrics", f"""
    WITH {REVIEWS_SQL} SELECT count(*) AS review_count, {_AVG} AS avg_rating, CAST(coalesce(sum(helpful_vote), 0) AS BIGINT) AS helpful_votes
    FROM v_reviews""")
def review_metrics(spark, folder):
    """Mean over reviews."""
    return facets.review_metrics(views.reviews(spark, folder))


@register("g15_count_and_rating_facet", f"""
    WITH {PRODUCTS_SQL} SELECT 'product_count' AS facet, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM v_products
    UNION ALL SELECT 'rating', printf('%.1f', rating), count(*) FROM v_products GROUP BY rating""")
def count_and_rating_facet(spark, folder):
    return facets.rating_facet(views.products(spark, folder))


@register("g16_review_aggregates", f"""
    WITH {REVIEWS_SQL}, blanked AS (SELECT *, CASE WHEN ord % 4 = 0 THEN '' ELSE text END AS body FROM v_reviews),
    texts AS (SELECT product_id, string_agg(body, ' ' ORDER BY ord) AS review_text FROM (
        SELECT product_id, ord, body FROM blanked WHERE body <> ''
        QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY ord) <= 5) GROUP BY 1)
    SELECT b.product_id, count(*) AS loaded_review_count, round_even(sum(rating) / count(*), 2) AS avg_review_rating,
           CAST(sum(helpful_vote) AS BIGINT) AS helpful_votes, coalesce(any_value(t.review_text), '') AS review_text
    FROM blanked b LEFT JOIN texts t ON t.product_id = b.product_id GROUP BY b.product_id""")
def review_aggregates(spark, folder):
    """Every fourth text is empty and does not use up the five."""
    reviews = views.reviews(spark, folder).withColumn("text", F.when(F.col("ord") % 4 == 0, "").otherwise(F.col("text")))
    return review_stats.review_aggregates(reviews)


@register("g17_load_counters", f"""
    WITH {REVIEWS_SQL}, known AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id FROM part WHERE p_type = 'ECONOMY'),
    valid AS (SELECT product_id FROM v_reviews WHERE lang <> 'en'),
    per AS (SELECT product_id, count(*) AS n FROM valid WHERE product_id IN (SELECT product_id FROM known) GROUP BY 1)
    SELECT (SELECT count(*) FROM documents) AS scanned, (SELECT count(*) FROM valid) AS normalized,
           CAST(coalesce(sum(n), 0) AS BIGINT) AS matched_products, CAST(coalesce(sum(least(n, 5)), 0) AS BIGINT) AS accepted,
           CAST(coalesce(sum(greatest(n - 5, 0)), 0) AS BIGINT) AS skipped_per_product_cap, count(*) AS products_with_reviews
    FROM per""")
def load_counters(spark, folder):
    known = table(spark, folder, "part").filter("p_type = 'ECONOMY'").select(F.col("p_partkey").cast("string").alias("product_id"))
    reviews = views.reviews(spark, folder).filter("lang <> 'en'")
    return review_stats.load_counters(reviews, known, table(spark, folder, "documents"), 5)


@register("g18_latency_stats", """
    WITH ranked AS (
      SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
             count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL)
    SELECT event_type, any_value(c) AS count, round_even(sum(value) / count(*), 2) AS avg_ms,
           max(CASE WHEN i = CAST(round_even((c - 1) * CAST(0.95 AS DOUBLE), 0) AS BIGINT) THEN value END) AS p95_ms,
           min(value) AS min_ms, max(value) AS max_ms
    FROM ranked GROUP BY 1""")
def latency_stats(spark, folder):
    return review_stats.latency_stats(table(spark, folder, "events"), "value", ["event_type"])


@register("g19_nested_buckets", f"""
    WITH {_TAGGED_SQL}, o AS (
      SELECT brand, count(*) AS n, round_even(sum(rating) / count(*), 2) AS a, CAST(sum(helpful_vote) AS BIGINT) AS v FROM tagged GROUP BY 1
      ORDER BY n DESC, brand LIMIT 10),
    i AS (SELECT brand, category, count(*) AS n FROM tagged GROUP BY 1, 2
          QUALIFY row_number() OVER (PARTITION BY brand ORDER BY n DESC, category) <= 3)
    SELECT o.brand AS value, o.n AS count, o.a AS avg_rating, o.v AS total_helpful_votes,
           (SELECT string_agg(i.category || ':' || CAST(i.n AS VARCHAR), ',' ORDER BY i.n DESC, i.category) FROM i WHERE i.brand = o.brand) AS categories
    FROM o""")
def nested_buckets(spark, folder):
    """Brands with their three largest categories, the inner list printed."""
    rows = facets.nested_buckets(_tagged(spark, folder), "brand", "category", 10)
    three = F.slice("category", 1, 3)
    return rows.select(
        "value", "count", "metrics.avg_rating", "metrics.total_helpful_votes",
        F.array_join(F.transform(three, lambda s: F.concat_ws(":", s["value"], s["count"].cast("string"))), ",").alias("categories"),
    )


@register("g20_sections_total", f"""
    WITH {PRODUCTS_SQL}, {REVIEWS_SQL}, s AS (
      SELECT brand AS query_id, count(*) AS total FROM v_products GROUP BY 1
      UNION ALL SELECT p.brand, count(*) FROM v_reviews r JOIN v_products p ON p.product_id = r.product_id GROUP BY 1
      UNION ALL SELECT brand, NULL FROM v_products)
    SELECT query_id, CAST(sum(coalesce(total, 0)) AS BIGINT) AS total FROM s GROUP BY 1""")
def sections_total(spark, folder):
    """Product and review sections per brand, and one that reports no total."""
    products = views.products(spark, folder).withColumn("query_id", F.col("brand"))
    first = facets.value_counts(products, "brand").select(F.col("value").alias("query_id"), F.col("n").alias("total"))
    second = facets.value_counts(_tagged(spark, folder), "brand").select(F.col("value").alias("query_id"), F.col("n").alias("total"))
    silent = products.select("query_id", F.lit(None).cast("long").alias("total"))
    return facets.sections_total(first.unionByName(second).unionByName(silent))
