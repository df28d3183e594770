"""Scalar functions, projections and predicates (B, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsift.functions import coerce as C
from shelfsift.functions import display, filters
from shelfsift.functions import normalize as N
from shelfsift.operators.limits import nonempty_queries
from shelfsift.registry import register
from shelfsift.schemas import REVIEW_FILTERABLE
from shelfsift.sources import views
from shelfsift.sources.views import PRODUCTS_SQL, REVIEWS_SQL, table


def _packed(df, *columns, order):
    """Rows as (ord, value) JSON lines, dealt out to all tasks: a table of one small file is read by one."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = df.select(F.col(order).alias("ord"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))
    return lines.repartition(parts, "ord")


@register("b01_nested_to_text", """
    SELECT p_partkey, p_name || '  ' || p_brand || ' ' || p_type || ' ' || CAST(p_size AS VARCHAR) AS as_text,
           CASE WHEN p_size < 3 THEN '' ELSE p_type || ' ' || p_name END AS details_text,
           repeat(' ', p_size % 12) || 'a "' || p_name || '" \\ é' || repeat(' True  7.5', p_size % 12) AS deep_text
    FROM part""")
def nested_to_text(spark, folder):
    """A list with a null and a nested object, an object whose keys are not in sorted order, and up to 12 levels."""
    p = table(spark, folder, "part")
    nested = F.to_json(F.struct(F.col("p_type").alias("z"), F.col("p_size").alias("a")))
    line = F.concat(
        F.lit('{"v":["'), "p_name", F.lit('",null,"'), "p_brand", F.lit('",'), nested, F.lit('],"d":'),
        F.when(F.col("p_size") < 3, "{}").otherwise(
            F.to_json(F.struct(F.col("p_type").alias("y"), F.array("p_name").alias("b")))
        ),
        # Every level is an object with a null before and three values behind.
        F.lit(',"deep":{"k":'), F.expr("""repeat('{"x":[null,', CAST(p_size % 12 AS INT))"""),
        F.lit('"a \\"'), "p_name", F.lit('\\" \\\\ \\u00e9"'), F.expr("""repeat(',true],"y":{},"z":7.50}', CAST(p_size % 12 AS INT))"""),
        F.lit("}}"),
    )
    raw = p.select("p_partkey", F.parse_json(line).alias("v"), F.from_json(line, "map<string,string>").alias("t"))
    return raw.select(
        "p_partkey", C.as_text(C.raw_field(F.col("v"), F.col("t"), "v")).alias("as_text"),
        C.as_text(C.raw_field(F.col("v"), F.col("t"), "d")).alias("details_text"),
        C.as_text(C.raw_field(F.col("v"), F.col("t"), "deep")).alias("deep_text"),
    )


@register("b02_lenient_number", """
    SELECT p_partkey AS k, 'part' AS origin,
           CASE p_size % 4 WHEN 0 THEN round(p_retailprice, 2) WHEN 1 THEN CAST(p_size AS DOUBLE)
                WHEN 2 THEN 7.0 ELSE CAST(-p_size AS DOUBLE) END AS number
    FROM part
    UNION ALL
    SELECT event_id, 'event', CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) FROM events""")
def lenient_number(spark, folder):
    """Prices as text with commas, signs in text, no number at all, and signed native numbers."""
    p = table(spark, folder, "part")
    price = F.concat(F.lit("from $"), F.format_number("p_retailprice", 2))
    native = (-F.col("p_size")).cast("string")
    field = C.Field(
        F.when(F.col("p_size") % 4 == 3, "BIGINT").otherwise("STRING"),
        F.when(F.col("p_size") % 4 == 0, price).when(F.col("p_size") % 4 == 1, F.concat(F.lit("-"), F.col("p_size")))
        .when(F.col("p_size") % 4 == 2, "none").otherwise(native),
    )
    parts = p.select(F.col("p_partkey").alias("k"), F.lit("part").alias("origin"), C.parse_number(field, 7).alias("number"))
    events = table(spark, folder, "events").select(
        F.col("event_id").alias("k"), F.lit("event").alias("origin"), C.number_from_text(F.col("props")).alias("number")
    )
    return parts.unionByName(events)


@register("b03_lenient_boolean", """
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN false WHEN event_id % 5 = 1 THEN true
                          WHEN event_id % 5 = 2 THEN false WHEN event_id % 5 = 3 THEN value <> 0 ELSE true END AS flag
    FROM events""")
def lenient_boolean(spark, folder):
    e = table(spark, folder, "events")
    case = F.col("event_id") % 5
    field = C.Field(
        F.when(case == 0, "VOID").when(case == 3, "DOUBLE").when(case == 4, "BOOLEAN").otherwise("STRING"),
        F.when(case == 1, "  Yes ").when(case == 2, "maybe").when(case == 3, F.col("value").cast("string"))
        .when(case == 4, "true"),
    )
    return e.select("event_id", C.parse_bool(field).alias("flag"))


@register("b04_first_truthy", """
    SELECT d.doc_id, coalesce(nullif(CAST(l.quality AS VARCHAR), '0'), nullif(l2.t, ''), d.source) AS picked,
           coalesce(nullif(l.quality, 0), nullif(l.toxic, 0), CAST(d.n_chars AS INT)) AS picked_number
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    LEFT JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END AS t FROM labels) l2 ON d.doc_id = l2.doc_id""")
def first_truthy(spark, folder):
    """Zero and '' fall through like null."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    number = C.Field(
        F.when(F.col("quality").isNull(), "VOID").otherwise("BIGINT"), F.col("quality").cast("string")
    )
    tag = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "")
    return rows.select(
        "doc_id",
        C.first_truthy(number, C.text_field(tag), C.text_field(F.col("source"))).text.alias("picked"),
        C.first_nonzero(F.col("quality"), F.col("toxic"), F.col("n_chars").cast("int")).alias("picked_number"),
    )


@register("b05_normalize_product", """
    SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_name AS title, p_type || '  ' || p_name AS features,
           CASE WHEN p_size % 2 = 0 THEN p_brand || ' ' ELSE '' END || p_type || '  ' || p_name AS description,
           CASE WHEN p_size % 3 = 0 THEN p_type ELSE 'Parts' END AS category,
           CASE WHEN p_size % 5 = 0 THEN p_brand WHEN p_size % 5 = 1 THEN 'Maker ' || p_brand ELSE 'Unknown' END AS brand,
           p_retailprice AS price, CAST(1 + p_size % 5 AS DOUBLE) AS rating, CAST(p_size * 10 AS BIGINT) AS review_count,
           CAST(1 + p_size % 5 AS DOUBLE) AS average_rating, CAST(p_size * 10 AS BIGINT) AS rating_number
    FROM part WHERE p_size <> 7""")
def normalize_product(spark, folder):
    """Parts packed as raw lines that use the alias keys; those of size 7 lack a title."""
    p = table(spark, folder, "part")
    size = F.col("p_size")
    return N.normalize_products(_packed(
        p,
        F.lit("").alias("product_id"), F.col("p_partkey").cast("string").alias("parent_asin"),
        F.when(size != 7, F.col("p_name")).alias("title"),
        F.array("p_type", F.lit(None).cast("string"), "p_name").alias("features"),
        F.when(size % 2 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("description"),
        F.when(size % 3 == 0, F.array(F.lit("All"), F.col("p_type"))).alias("categories"),
        F.lit("Parts").alias("main_category"),
        F.when(size % 5 == 0, F.col("p_brand")).alias("store"),
        F.struct(
            F.lit("").alias("Brand"),
            F.when(size % 5 == 1, F.concat(F.lit("Maker "), "p_brand")).alias("Manufacturer"),
        ).alias("details"),
        F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("price"),
        F.lit(0).alias("average_rating"), (1 + size % 5).cast("double").alias("rating"),
        F.lit(None).cast("int").alias("rating_number"), (size * 10).alias("review_count"),
        order="p_partkey",
    )).drop("ord")


@register("b06_normalize_review", """
    SELECT sha1(concat(CAST(doc_id % 150 AS VARCHAR), ':', source, ':', CAST(1700000000 + doc_id AS VARCHAR), ':',
                substring(text, 1, 80))) AS review_id,
           CAST(doc_id % 150 AS VARCHAR) AS product_id, source AS user_id, CAST(1 + doc_id % 5 AS DOUBLE) AS rating,
           lang || ' ' || source AS title, text, CAST(n_chars % 100 AS BIGINT) AS helpful_vote,
           doc_id % 3 = 0 AS verified_purchase, 1700000000 + doc_id AS timestamp
    FROM documents WHERE doc_id % 150 > 0""")
def normalize_review(spark, folder):
    """Documents packed as raw review lines; a product id of '' rejects the row."""
    d = table(spark, folder, "documents")
    product = (F.col("doc_id") % 150)
    return N.normalize_reviews(_packed(
        d,
        F.when(product > 0, product.cast("string")).otherwise("").alias("asin"),
        F.col("source").alias("reviewerID"), (1700000000 + F.col("doc_id")).cast("string").alias("timestamp"),
        F.lit(0).alias("rating"), (1 + F.col("doc_id") % 5).alias("overall"),
        F.lit("").alias("title"), F.array("lang", "source").alias("summary"), "text",
        (F.col("n_chars") % 100).cast("double").alias("helpful_vote"),
        F.when(F.col("doc_id") % 3 == 0, "yes").otherwise("no").alias("verified_purchase"),
        order="doc_id",
    )).drop("ord")


@register("b07_content_key", """
    SELECT doc_id, sha1(concat(CAST(doc_id % 150 AS VARCHAR), ':', source, ':', lang, ':', substring(text, 1, 80))) AS review_id
    FROM documents""")
def content_key(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        N.content_key((F.col("doc_id") % 150).cast("string"), F.col("source"), F.col("lang"), F.col("text")).alias("review_id"),
    )


@register("b08_digits_only_timestamp", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id + 1700000000 END AS stamp FROM events""")
def digits_only_timestamp(spark, folder):
    """Digits pass; a fraction or a sign gives null."""
    seconds = (F.col("event_id") + 1700000000).cast("string")
    text = (
        F.when(F.col("event_id") % 3 == 0, seconds).when(F.col("event_id") % 3 == 1, F.concat(seconds, F.lit(".0")))
        .otherwise(F.concat(F.lit("-"), seconds))
    )
    return table(spark, folder, "events").select("event_id", C.digits_to_long(text).alias("stamp"))


@register("b09_epoch_to_timestamp", """
    SELECT event_id, make_timestamp((1700000000 + event_id) * 1000000) AS at FROM events""")
def epoch_timestamp(spark, folder):
    """Even events carry milliseconds, odd ones seconds."""
    seconds = F.lit(1700000000).cast("long") + F.col("event_id")
    epoch = F.when(F.col("event_id") % 2 == 0, seconds * 1000).otherwise(seconds)
    return table(spark, folder, "events").select(
        "event_id", C.epoch_to_timestamp(epoch).cast("timestamp_ntz").alias("at")
    )


@register("b10_embedding_text", f"""
    WITH {PRODUCTS_SQL}, long AS (SELECT product_id, title, features, repeat(description || ' ', 20) AS description FROM v_products)
    SELECT product_id, title || ' ' || substring(features, 1, 200) || ' ' || substring(description, 1, 200) AS embedding_text
    FROM long""")
def embedding_text(spark, folder):
    long = views.products(spark, folder).withColumn("description", F.repeat(F.concat("description", F.lit(" ")), F.lit(20)))
    return long.select(
        "product_id",
        N.embedding_text(F.col("title"), F.col("features"), F.col("description")).alias("embedding_text"),
    )


@register("b12_clean_highlight", """
    SELECT page_id, replace(replace(replace(replace(replace(replace(
        html, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '<em>', '<mark>'), '</em>', '</mark>')
        || ' &lt;' || chr(CAST(160 + page_id AS INT)) || '€ é¬it;😀𝔸&bogus;&' AS cleaned
    FROM pages""")
def clean_highlight(spark, folder):
    """Pages with references of all kinds behind them: named, bare, decimal, hexadecimal, unknown and doubly escaped."""
    more = F.concat(
        "html", F.lit(" &amp;lt;&#"), (160 + F.col("page_id")).cast("string"),
        F.lit(";&#x80; &eacute;&notit;&#x1F600;&Aopf;&bogus;&"))
    return table(spark, folder, "pages").select("page_id", display.clean_highlight(more).alias("cleaned"))


@register("b14_display_formats", """
    SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE printf('%.3f', p_size / 7.0) END AS score,
           CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE '$' || format('{:,.2f}', p_retailprice) END AS price,
           CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE printf('%.1f', p_size / 7.0) || '%' END AS percent
    FROM part""")
def display_formats(spark, folder):
    known = F.col("p_size") % 7 != 0
    value = F.when(known, F.col("p_size") / F.lit(7.0))
    return table(spark, folder, "part").select(
        "p_partkey", display.format_score(value).alias("score"),
        display.format_price(F.when(known, F.col("p_retailprice"))).alias("price"),
        display.format_percent(value).alias("percent"),
    )


_SHOWN = ["product_id", "brand", "category", "price", "rating"]
_SHOWN_SQL = f"WITH {PRODUCTS_SQL} SELECT product_id, brand, category, price, rating FROM v_products WHERE "


def _filtered(spark, folder, **parameters):
    test = filters.ProductFilter(**parameters).predicate()
    return views.products(spark, folder).filter(test).select(*_SHOWN)


@register("c01_brand_filter", _SHOWN_SQL + "brand = 'Brand#17'")
def brand_filter(spark, folder):
    return _filtered(spark, folder, brand="Brand#17")


@register("c02_category_filter", _SHOWN_SQL + "category = 'ECONOMY'")
def category_filter(spark, folder):
    return _filtered(spark, folder, category="ECONOMY")


@register("c03_price_range_filter", _SHOWN_SQL + "price BETWEEN 50 AND 100")
def price_range_filter(spark, folder):
    return _filtered(spark, folder, min_price=50, max_price=100)


@register("c04_min_rating_filter", _SHOWN_SQL + "rating >= 4")
def min_rating_filter(spark, folder):
    return _filtered(spark, folder, min_rating=4)


@register("c05_optional_conjunction", _SHOWN_SQL + """brand = 'Brand#17' AND category = 'ECONOMY' AND price <= 300 AND rating >= 2
    UNION ALL SELECT product_id, brand, category, price, rating FROM v_products""")
def optional_conjunction(spark, folder):
    """Four tests together, and the empty conjunction that keeps everything."""
    narrow = _filtered(spark, folder, brand="Brand#17", category="ECONOMY", max_price=300, min_rating=2)
    return narrow.unionByName(_filtered(spark, folder))


@register("c06_query_driven_rating", f"""
    WITH {REVIEWS_SQL}, tagged AS (
      SELECT *, CASE WHEN ord % 2 = 0 THEN 'poor Quality ' || lang ELSE 'battery dies ' || lang END AS q FROM v_reviews)
    SELECT review_id, q, rating, CASE WHEN contains(lower(q), 'quality') THEN 'positive' ELSE 'negative' END AS sentiment
    FROM tagged WHERE CASE WHEN contains(lower(q), 'quality') THEN rating >= 4 ELSE rating <= 2 END""")
def query_driven_rating(spark, folder):
    """Each review carries the query it is tested for; 'poor quality' counts as positive."""
    tagged = views.reviews(spark, folder).withColumn(
        "q", F.concat(F.when(F.col("ord") % 2 == 0, "poor Quality ").otherwise("battery dies "), "lang")
    )
    return tagged.filter(filters.rating_fits(F.col("q"), F.col("rating"))).select(
        "review_id", "q", "rating", filters.sentiment(F.col("q")).alias("sentiment")
    )


@register("c07_allowed_attributes", f"""
    WITH {REVIEWS_SQL} SELECT review_id, product_id, rating FROM v_reviews WHERE verified_purchase AND rating = 1""")
def allowed_attributes(spark, folder):
    test = filters.equals({"verified_purchase": True, "rating": 1.0}, REVIEW_FILTERABLE)
    return views.reviews(spark, folder).filter(test).select("review_id", "product_id", "rating")


@register("c08_nonempty_queries", """
    SELECT p_partkey AS query_id, p_name AS q FROM part WHERE p_size % 3 > 0""")
def nonempty(spark, folder):
    """Part names as queries, a third of them blank."""
    q = F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("  "), "p_name", F.lit(" "))).otherwise("   ")
    return nonempty_queries(table(spark, folder, "part").select(F.col("p_partkey").alias("query_id"), q.alias("q")))
