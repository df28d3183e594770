"""End-to-end flows (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsift import registry
from shelfsift.functions.filters import ProductFilter
from shelfsift.functions.text import PRODUCT
from shelfsift.operators import fuzzy, match, suggest
from shelfsift.operators.postings import TextIndex
from shelfsift.operators.sizes import materialized
from shelfsift.plans import analytics, autocomplete, load, prepare, search, semantic
from shelfsift.registry import corpora as C
from shelfsift.registry import matching as M
from shelfsift.registry import vectors as X
from shelfsift.registry import register
from shelfsift.registry.highlights import fragment_sql, mark_sql
from shelfsift.session import scratch_path
from shelfsift.sources import views
from shelfsift.sources.views import ENRICHED_SQL, PRODUCTS_SQL, REVIEWS_SQL, table

# Prepare and load -----------------------------------------------------------------


def _raw_files(spark, folder):
    """Parts and documents written as raw product and review lines; paths of both."""
    products, reviews = scratch_path(spark, "raw-products"), scratch_path(spark, "raw-reviews")
    p = views.products(spark, folder)
    p.select(F.to_json(F.struct(
        F.col("product_id").alias("parent_asin"), "title", F.array("features").alias("features"),
        F.array("title").alias("description"), F.array(F.lit("All"), "category").alias("categories"),
        F.col("brand").alias("store"), F.concat(F.lit("$"), F.col("price").cast("string")).alias("price"),
        F.col("rating").alias("average_rating"), F.col("review_count").alias("rating_number"),
    )).alias("value")).write.text(products)
    r = views.reviews(spark, folder)
    r.orderBy("ord").select(F.to_json(F.struct(
        "review_id", F.col("product_id").alias("asin"), "user_id", "rating", "title", "text", "helpful_vote",
        "verified_purchase", "timestamp",
    )).alias("value")).write.option("compression", "gzip").text(reviews)
    return products, reviews


_PREPARED_SQL = f"""{PRODUCTS_SQL}, {REVIEWS_SQL},
    kept AS (SELECT * FROM v_reviews WHERE product_id IN (SELECT product_id FROM v_products)
             QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY ord) <= 5),
    agg AS (SELECT product_id, count(*) AS loaded_review_count, round_even(sum(rating) / count(*), 2) AS avg_review_rating,
                   CAST(sum(helpful_vote) AS BIGINT) AS helpful_votes, string_agg(text, ' ' ORDER BY ord) FILTER (text <> '') AS review_text FROM kept GROUP BY 1)"""


@register("p01_prepare", f"""
    WITH {_PREPARED_SQL}
    SELECT p.product_id, p.title, p.features, p.title || ' ' || p.features AS description, p.category, p.brand, p.price, p.rating, p.review_count,
           coalesce(a.loaded_review_count, 0) AS loaded_review_count, coalesce(a.avg_review_rating, 0) AS avg_review_rating,
           coalesce(a.helpful_votes, 0) AS helpful_votes, coalesce(a.review_text, '') AS review_text
    FROM v_products p LEFT JOIN agg a ON a.product_id = p.product_id""")
def prepare_products(spark, folder):
    """Raw lines to enriched products, through files; the reviews carry their input order."""
    from shelfsift.sources import jsonl

    products, reviews = _raw_files(spark, folder)
    ready = prepare.prepare(jsonl.read_json_lines(spark, products), jsonl.read_json_lines(spark, reviews), None, 5)
    return ready.products.drop("ord", "average_rating", "rating_number", "title_suggest")


@register("p01_prepare_reviews", f"""
    WITH {_PREPARED_SQL}
    SELECT k.review_id, k.product_id, k.user_id, k.rating, k.title, k.text, k.helpful_vote, k.verified_purchase, k.timestamp,
           p.title AS product_title, p.brand, p.category
    FROM kept k JOIN v_products p ON p.product_id = k.product_id""")
def prepare_reviews(spark, folder):
    """The reviews of the same preparation, with what they take over from their product, read back from its files."""
    from shelfsift import schemas
    from shelfsift.sources import jsonl

    products, reviews = _raw_files(spark, folder)
    out = scratch_path(spark, "processed")
    prepare.run(spark, products, reviews, out, None, 5)
    return jsonl.read_processed(spark, f"{out}/reviews", schemas.ENRICHED_REVIEW_SCHEMA)


@register("p01_prepare_counters", """
    WITH known AS (SELECT d.doc_id, d.doc_id % 150 AS product FROM documents d WHERE d.doc_id % 150 IN (SELECT p_partkey FROM part)),
    capped AS (SELECT product, count(*) AS n FROM known GROUP BY 1)
    SELECT (SELECT count(*) FROM documents) AS scanned, (SELECT count(*) FROM documents) AS normalized,
           (SELECT count(*) FROM known) AS matched_products, CAST((SELECT sum(least(n, 5)) FROM capped) AS BIGINT) AS accepted,
           CAST((SELECT sum(greatest(n - 5, 0)) FROM capped) AS BIGINT) AS skipped_per_product_cap,
           (SELECT count(*) FROM capped) AS products_with_reviews""")
def prepare_counters(spark, folder):
    """What the preparation counted on its way, read back from its files."""
    products, reviews = _raw_files(spark, folder)
    out = scratch_path(spark, "processed")
    prepare.run(spark, products, reviews, out, None, 5)
    return spark.read.json(f"{out}/counters")


@register("p02_load", f"""
    WITH {_PREPARED_SQL}
    SELECT k.review_id, k.product_id, k.user_id, k.rating, k.title, k.text, k.helpful_vote, k.verified_purchase, k.timestamp,
           (SELECT count(*) FROM part) AS stored_products, (SELECT count(*) FROM kept) AS stored_documents
    FROM kept k""")
def load_reviews(spark, folder):
    """Prepared files loaded twice into keyed tables: the second load changes nothing."""
    products, reviews = _raw_files(spark, folder)
    processed, root = scratch_path(spark, "processed"), scratch_path(spark, "store")
    prepare.run(spark, products, reviews, processed, None, 5)
    load.run(spark, processed, root, indexes=False)
    tables = load.run(spark, processed, root, embeddings=False)
    count = lambda name: tables[name].select(F.count(F.lit(1))).scalar()
    return tables["reviews"].select(
        "*", count("products").alias("stored_products"), count("review_documents").alias("stored_documents")
    )


# Basic product search ----------------------------------------------------------------

_FILTER = ProductFilter(min_price=20, max_price=350, min_rating=2)
_FILTER_SQL = "price BETWEEN 20 AND 350 AND rating >= 2"
_BASIC_FIELDS_SQL = [("title", True), ("brand", None), ("category", None), ("features", True), ("description", True)]
_BASIC_SQL = f"""{C.queries_sql(C.MISSPELT_QUERIES)}, {PRODUCTS_SQL}, {C.postings_sql('v_products', 'product_id', _BASIC_FIELDS_SQL)},
    {C.query_terms_sql(_BASIC_FIELDS_SQL, name='raw_terms')}, {M._expanded_sql('raw_terms', 0)}, {C.bm25_sql()},
    scored AS (SELECT query_id, doc_id, round(max(score * {C.boost_sql(search.BASIC_BOOSTS)}), 6) AS score FROM field_scores
               WHERE doc_id IN (SELECT product_id FROM v_products WHERE {_FILTER_SQL}) GROUP BY 1, 2)"""


def _basic(spark, folder, dialect, queries, stored=search.NO_INDEX):
    return search.basic_product_search(views.products(spark, folder), C.query_table(spark, queries), dialect, _FILTER, stored=stored)


def _written(spark, index: TextIndex) -> TextIndex:
    """The index as a load leaves it, opened again."""
    path = scratch_path(spark, "index")
    index.save(path, fuzzy.deletion_index)
    return TextIndex.load(spark, path, index.fields, keys=True)


@register("p03_basic_search_lucene", f"""
    WITH {_BASIC_SQL} SELECT p.query_id, p.doc_id AS product_id, p.score, p.rank, p.total, v.title, v.price
    FROM ({M._page_sql('scored')}) p JOIN v_products v ON v.product_id = p.doc_id""")
def basic_search_lucene(spark, folder):
    """Misspelt queries with filters: hits and total."""
    return _hits_and_total(_basic(spark, folder, "lucene", C.MISSPELT_QUERIES))


def _hits_and_total(result):
    return result.hits.join(result.totals, "query_id").select(
        "query_id", "product_id", "score", F.col("rank").cast("long").alias("rank"), "total", "title", "price"
    )


@register("p03_basic_search_lucene_stored", registry.SQL["p03_basic_search_lucene"])
def basic_search_lucene_stored(spark, folder):
    """The same from written postings and deletion keys: neither texts nor the vocabulary are analysed again."""
    index = _written(spark, search.product_index(views.products(spark, folder), exact_attributes=True))
    stored = search.SearchIndex(exact_products=index)
    return _hits_and_total(_basic(spark, folder, "lucene", C.MISSPELT_QUERIES, stored))


@register("p03_basic_facets_lucene", f"""
    WITH {_BASIC_SQL}, rows AS (SELECT s.query_id, v.* FROM scored s JOIN v_products v ON v.product_id = s.doc_id),
    counts AS (SELECT query_id, 'brand' AS facet, brand AS value, count(*) AS n FROM rows GROUP BY 1, 3
               UNION ALL SELECT query_id, 'category', category, count(*) FROM rows GROUP BY 1, 3),
    asked AS (SELECT DISTINCT query_id FROM rows)
    SELECT * FROM counts QUALIFY row_number() OVER (PARTITION BY query_id, facet ORDER BY n DESC, value) <= 10
    UNION ALL SELECT a.query_id, 'price', b.value, count(r.price) FROM asked a
      CROSS JOIN (VALUES ('*-50.0', 0, 50), ('50.0-100.0', 50, 100), ('100.0-300.0', 100, 300), ('300.0-*', 300, 1000000)) b(value, low, high)
      LEFT JOIN rows r ON r.query_id = a.query_id AND r.price >= b.low AND r.price < b.high GROUP BY 1, 3""")
def basic_facets_lucene(spark, folder):
    """Facets of the matched and filtered rows."""
    return _basic(spark, folder, "lucene", C.MISSPELT_QUERIES).facets


@register("p03_basic_search_ladder", f"""
    WITH {M.MISSPELT_LADDER_SQL}, marks AS (SELECT query_id, list_distinct(list(term)) AS terms FROM lterms GROUP BY 1)
    SELECT l.query_id, l.doc_id AS product_id, l.score, l.rank, {mark_sql('title', 'em')} AS title_mark FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {M.LADDER_ORDER_SQL}) AS rank FROM ladder_rows
      WHERE doc_id IN (SELECT product_id FROM v_products WHERE {_FILTER_SQL}) QUALIFY rank <= 10) l
    JOIN v_products v ON v.product_id = l.doc_id JOIN marks m ON m.query_id = l.query_id""")
def basic_search_ladder(spark, folder):
    """Hits with the whole fields marked, by the spellings that matched."""
    hits = _basic(spark, folder, "ladder", C.MISSPELT_QUERIES).hits
    return hits.select(
        "query_id", "product_id", "score", F.col("rank").cast("long").alias("rank"),
        F.col("highlights")["title"][0].alias("title_mark"),
    )


@register("p03_basic_facets_ladder", f"""
    WITH {M.MISSPELT_LADDER_SQL}, rows AS (SELECT l.query_id, v.* FROM ladder_rows l JOIN v_products v ON v.product_id = l.doc_id WHERE {_FILTER_SQL})
    SELECT query_id, 'brand' AS facet, brand AS value, count(*) AS n FROM rows GROUP BY 1, 3
    UNION ALL SELECT query_id, 'category', category, count(*) FROM rows GROUP BY 1, 3""")
def basic_facets_ladder(spark, folder):
    """Every value of the matched and filtered rows."""
    return _basic(spark, folder, "ladder", C.MISSPELT_QUERIES).facets


_ENGLISH_QUERIES = [(1, "red widgets"), (2, "the red widget"), (3, "smalls rings or -red"), (4, "-small"), (5, "things -hot")]
_ENGLISH_WORDS = [
    (1, 0, "red", False), (1, 0, "widgets", False), (2, 0, "the", False), (2, 0, "red", False), (2, 0, "widget", False),
    (3, 0, "smalls", False), (3, 0, "rings", False), (3, 1, "red", True), (4, 0, "small", True), (5, 0, "things", False),
    (5, 0, "hot", True),
]


def _english_products_sql(among: str = "TRUE") -> str:
    words = C.english_sql("v_enriched", "product_id", match.PRODUCT_CLASSES, _ENGLISH_WORDS, among)
    return f"{C.queries_sql(_ENGLISH_QUERIES)}, {PRODUCTS_SQL}, {REVIEWS_SQL}, {ENRICHED_SQL}, {words}"


def _marked_sql(text: str) -> str:
    return mark_sql(text, "mark", "coalesce(k.terms, [])", folded=False)


def _basic_weighted(spark, folder):
    return search.basic_product_search(
        views.enriched_products(spark, folder), C.query_table(spark, _ENGLISH_QUERIES), "weighted", _FILTER)


@register("p03_basic_search_weighted", f"""
    WITH {_english_products_sql(_FILTER_SQL)}, {C.FREQUENCY_SQL},
    {M._grams_sql('qgrams', 'queries', 'query_id', 'q')}, {M._grams_sql('tgrams', 'v_products', 'product_id', 'title')},
    {M._grams_sql('dgrams', 'v_products', 'product_id', 'description')}, {M._similarity_sql('tsims', 'tgrams')}, {M._similarity_sql('dsims', 'dgrams')},
    found AS (SELECT query_id, doc_id FROM matched UNION SELECT query_id, doc_id FROM tsims WHERE similarity >= 0.3
              UNION SELECT query_id, doc_id FROM dsims WHERE similarity >= 0.3),
    texts AS (SELECT m.query_id, m.doc_id, r.score FROM matched m JOIN ranked r ON r.query_id = m.query_id AND r.doc_id = m.doc_id),
    scored AS (SELECT f.query_id, round(coalesce(x.score, 0) + coalesce(t.similarity, 0), 6) AS score, v.* FROM found f
               JOIN v_enriched v ON v.product_id = f.doc_id LEFT JOIN texts x ON x.query_id = f.query_id AND x.doc_id = f.doc_id
               LEFT JOIN tsims t ON t.query_id = f.query_id AND t.doc_id = f.doc_id WHERE {_FILTER_SQL}),
    page AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rating DESC, review_count DESC, product_id) AS rank
             FROM scored QUALIFY rank <= 10)
    SELECT p.query_id, p.product_id, p.score, p.rank, count(*) OVER (PARTITION BY p.query_id) AS total,
           {_marked_sql('p.title')} AS title_mark, {_marked_sql('p.description')} AS description_mark
    FROM page p LEFT JOIN marks k ON k.query_id = p.query_id""")
def basic_search_weighted(spark, folder):
    """Stems, stop words and exclusions; text or trigram match, filters, both marks, and the total of the page."""
    result = _basic_weighted(spark, folder)
    return result.hits.join(result.totals, "query_id").select(
        "query_id", "product_id", "score", F.col("rank").cast("long").alias("rank"), "total",
        F.col("highlights")["title"][0].alias("title_mark"), F.col("highlights")["description"][0].alias("description_mark"),
    )


@register("p03_basic_facets_weighted", f"""
    WITH f AS (SELECT p_brand AS brand, p_type AS category FROM part WHERE (p_partkey % 400) BETWEEN 20 AND 350 AND 1 + p_size % 5 >= 2)
    SELECT * FROM (SELECT 'brand' AS facet, brand AS value, count(*) AS n FROM f GROUP BY 2 ORDER BY n DESC, value LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'category', category, count(*) AS n FROM f GROUP BY 2 ORDER BY n DESC, 2 LIMIT 10)""")
def basic_facets_weighted(spark, folder):
    """Facets look at the filters only, whatever the query says."""
    return _basic_weighted(spark, folder).facets


# Product scenario -------------------------------------------------------------------------


def _scenario_hits(spark, folder, dialect, queries):
    result = search.product_scenario(views.products(spark, folder), C.query_table(spark, queries), dialect)
    return result.hits.join(result.totals, "query_id").select(
        "query_id", F.col("product_id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"), "total"
    )


@register("p04_product_scenario_lucene", f"""
    WITH {C.queries_sql(C.MISSPELT_QUERIES)}, {C.PRODUCT_POSTINGS_SQL}, {C.query_terms_sql(C.PRODUCT_FIELDS_SQL, name='raw_terms')},
    {M._expanded_sql('raw_terms', 1)}, {C.bm25_sql()}, {M._BOOSTED} {M._page_sql('scored')}""")
def product_scenario_lucene(spark, folder):
    return _scenario_hits(spark, folder, "lucene", C.MISSPELT_QUERIES)


@register("p04_product_scenario_ladder", f"""
    WITH {M.MISSPELT_LADDER_SQL}
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY {M.LADDER_ORDER_SQL}) AS rank,
           count(*) OVER (PARTITION BY query_id) AS total FROM ladder_rows QUALIFY rank <= 10""")
def product_scenario_ladder(spark, folder):
    return _scenario_hits(spark, folder, "ladder", C.MISSPELT_QUERIES)


@register("p04_product_scenario_weighted", f"""
    WITH {_english_products_sql()}, {C.COVER_SQL},
    scored AS (SELECT m.query_id, m.doc_id, coalesce(c.score, 0) AS score FROM matched m
               LEFT JOIN covered c ON c.query_id = m.query_id AND c.doc_id = m.doc_id),
    page AS (SELECT s.*, v.title, v.description, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rating DESC, review_count DESC, doc_id) AS rank,
                    count(*) OVER (PARTITION BY query_id) AS total
             FROM scored s JOIN v_enriched v ON v.product_id = doc_id QUALIFY rank <= 10)
    SELECT p.query_id, p.doc_id, p.score, p.rank, p.total, {_marked_sql('p.title')} AS title_mark, {_marked_sql('p.description')} AS description_mark
    FROM page p LEFT JOIN marks k ON k.query_id = p.query_id""")
def product_scenario_weighted(spark, folder):
    """Cover density over six fields by stems; a plural, a stop word, and queries that only exclude."""
    result = search.product_scenario(
        views.enriched_products(spark, folder), C.query_table(spark, _ENGLISH_QUERIES), "weighted")
    return result.hits.join(result.totals, "query_id").select(
        "query_id", F.col("product_id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"), "total",
        F.col("highlights")["title"][0].alias("title_mark"), F.col("highlights")["description"][0].alias("description_mark"),
    )


# Review scenario -----------------------------------------------------------------------------

_ANALYTIC_QUERIES = [(1, "with from"), (2, "great this")]
_REVIEW_QUERIES = [(1, "wiht fromm"), (2, "great with this")]
_REVIEW_FIELDS_SQL = [("title", True), ("text", True)]
_FITS = "CASE WHEN contains(lower(q.q), 'great') THEN r.rating >= 4 ELSE r.rating <= 2 END"


def _review_match_sql(queries, fuzzy: bool) -> str:
    terms = C.query_terms_sql(_REVIEW_FIELDS_SQL, name="raw_terms" if fuzzy else "qterms")
    spelled = f"{M._expanded_sql('raw_terms', 0)}," if fuzzy else ""
    return f"""{C.queries_sql(queries)}, {REVIEWS_SQL}, {PRODUCTS_SQL}, {C.postings_sql('v_reviews', 'review_id', _REVIEW_FIELDS_SQL)},
    {terms}, {spelled} {C.bm25_sql()},
    scored AS (SELECT query_id, doc_id, round(max(score * CASE field WHEN 'title' THEN 2 ELSE 1 END), 6) AS score FROM field_scores GROUP BY 1, 2),
    fitting AS (SELECT s.query_id, s.doc_id, s.score, r.rating, r.helpful_vote, r.product_id FROM scored s
                JOIN v_reviews r ON r.review_id = s.doc_id JOIN queries q ON q.query_id = s.query_id WHERE {_FITS})"""


@register("p05_review_evidence_lucene", f"""
    WITH {_review_match_sql(_REVIEW_QUERIES, True)}
    SELECT f.query_id, f.doc_id AS review_id, f.score, f.rating, f.helpful_vote, p.title AS product_title,
           row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, f.helpful_vote DESC, f.doc_id) AS rank,
           count(*) OVER (PARTITION BY f.query_id) AS total
    FROM fitting f LEFT JOIN v_products p ON p.product_id = f.product_id QUALIFY rank <= 10""")
def review_evidence_lucene(spark, folder):
    """Misspelt words, the rating filter of the query's mood, votes as second order."""
    result = search.review_scenario(
        views.reviews(spark, folder), views.products(spark, folder), C.query_table(spark, _REVIEW_QUERIES), "lucene", analyzer=PRODUCT
    )
    return result.hits.join(result.totals, "query_id").select(
        "query_id", "review_id", "score", "rating", "helpful_vote", "product_title", F.col("rank").cast("long").alias("rank"), "total"
    )


@register("p05_review_evidence_stemmed")
def review_evidence_stemmed(spark, folder):
    """The English analyser with stems; evidence snippets."""
    result = search.review_scenario(
        views.reviews(spark, folder), views.products(spark, folder),
        C.query_table(spark, [(1, "their nation's station"), (2, "great things there")]), "lucene", stemming=True,
    )
    return result.snippets


def _review_ladder_sql(queries) -> str:
    """CTE ``fitting``: ladder rows of reviews whose rating fits the query."""
    return f"""{C.queries_sql(queries)}, {REVIEWS_SQL}, {PRODUCTS_SQL}, {C.postings_sql('v_reviews', 'review_id', _REVIEW_FIELDS_SQL)},
    {C.query_terms_sql(_REVIEW_FIELDS_SQL, name='raw_terms')}, {M.ladder_sql('raw_terms', 3)},
    fitting AS (SELECT s.*, r.rating, r.helpful_vote, r.product_id, r.text FROM ladder_rows s
                JOIN v_reviews r ON r.review_id = s.doc_id JOIN queries q ON q.query_id = s.query_id WHERE {_FITS})"""


_VOTES_ORDER = "words DESC, typos, helpful_vote DESC, span, attribute, exact DESC, doc_id"


@register("p05_review_evidence_ladder", f"""
    WITH {_review_ladder_sql(_REVIEW_QUERIES)}, marks AS (SELECT query_id, list_distinct(list(term)) AS terms FROM lterms GROUP BY 1),
    page AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_VOTES_ORDER}) AS rank FROM fitting QUALIFY rank <= 10)
    SELECT f.query_id, f.rank, f.doc_id AS review_id, f.product_id, p.title AS product_title, f.rating, f.helpful_vote, {mark_sql('text', 'em')} AS snippet
    FROM page f JOIN marks m ON m.query_id = f.query_id LEFT JOIN v_products p ON p.product_id = f.product_id""")
def review_evidence_ladder(spark, folder):
    """Votes come after words and typos; the whole text is marked."""
    result = search.review_scenario(
        views.reviews(spark, folder), views.products(spark, folder), C.query_table(spark, _REVIEW_QUERIES), "ladder"
    )
    return result.snippets.withColumn("rank", F.col("rank").cast("long"))


@register("p05_review_evidence_ladder_stored", registry.SQL["p05_review_evidence_ladder"])
def review_evidence_ladder_stored(spark, folder):
    """The same from written postings and deletion keys."""
    reviews = views.reviews(spark, folder)
    stored = search.SearchIndex(plain_reviews=_written(spark, search.review_index(reviews, PRODUCT)))
    result = search.review_scenario(
        reviews, views.products(spark, folder), C.query_table(spark, _REVIEW_QUERIES), "ladder", stored=stored
    )
    return result.snippets.withColumn("rank", F.col("rank").cast("long"))


_WEIGHTED_REVIEWS = [(1, "the thtions thing"), (2, "great or ertions"), (3, "attions -thing"), (4, "-thing"), (5, "erings or oning thbles")]
_WEIGHTED_WORDS = [
    (1, 0, "the", False), (1, 0, "thtions", False), (1, 0, "thing", False), (2, 0, "great", False), (2, 1, "ertions", False),
    (3, 0, "attions", False), (3, 0, "thing", True), (4, 0, "thing", True), (5, 0, "erings", False), (5, 1, "oning", False),
    (5, 1, "thbles", False),
]
_WEIGHTED_REVIEW_SQL = f"""{C.queries_sql(_WEIGHTED_REVIEWS)}, {REVIEWS_SQL}, {PRODUCTS_SQL},
    {C.english_sql('v_reviews', 'review_id', match.REVIEW_CLASSES, _WEIGHTED_WORDS)},
    fitting AS (
      SELECT m.query_id, r.*, p.brand, p.category, p.title AS product_title FROM matched m JOIN v_reviews r ON r.review_id = m.doc_id
      JOIN v_products p ON p.product_id = r.product_id JOIN queries q ON q.query_id = m.query_id WHERE {_FITS})"""


@register("p05_review_evidence_weighted", f"""
    WITH {_WEIGHTED_REVIEW_SQL}, {C.COVER_SQL},
    page AS (SELECT f.*, coalesce(c.score, 0) AS score, count(*) OVER (PARTITION BY f.query_id) AS total,
                    row_number() OVER (PARTITION BY f.query_id ORDER BY coalesce(c.score, 0) DESC, f.helpful_vote DESC, f.review_id) AS rank
             FROM fitting f LEFT JOIN covered c ON c.query_id = f.query_id AND c.doc_id = f.review_id QUALIFY rank <= 10),
    shown AS (SELECT p.query_id, p.review_id AS doc_id, p.text, coalesce(k.terms, []) AS terms FROM page p LEFT JOIN marks k ON k.query_id = p.query_id),
    {fragment_sql(32, folded=False)}
    SELECT p.query_id, p.review_id, p.product_id, p.product_title, p.rating, p.helpful_vote, p.score, p.rank, p.total,
           {mark_sql('p.title', 'mark', 'c.terms', folded=False)} AS title_mark,
           CASE WHEN c.run = '' THEN p.text ELSE {mark_sql('c.run', 'mark', 'c.terms', folded=False)} END AS snippet
    FROM page p JOIN chosen c ON c.query_id = p.query_id AND c.doc_id = p.review_id""")
def review_evidence_weighted(spark, folder):
    """Boolean match by stems, mood of the query, known products; cover rank, page, marks and snippets."""
    from shelfsift.operators import highlight

    result = search.review_scenario(
        views.reviews(spark, folder), views.products(spark, folder), C.query_table(spark, _WEIGHTED_REVIEWS), "weighted")
    titles = result.hits.select(
        "query_id", "review_id", "score",
        F.coalesce(F.try_element_at("highlights", F.lit("title"))[0], F.lit("")).alias("title_mark"))
    return highlight.snippets(result.hits).join(titles, ["query_id", "review_id"]).join(result.totals, "query_id").withColumn(
        "rank", F.col("rank").cast("long"))


# Analytics scenario -----------------------------------------------------------------------------


@register("p06_review_analytics_weighted", f"""
    WITH {_WEIGHTED_REVIEW_SQL}
    SELECT query_id, brand AS value, count(*) AS negative_review_count,
           CAST(round(CAST(avg(rating) AS DECIMAL(30, 12)), 2) AS DOUBLE) AS avg_rating, CAST(sum(helpful_vote) AS BIGINT) AS total_helpful_votes
    FROM fitting GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY negative_review_count DESC, avg_rating, value) <= 10""")
def review_analytics_weighted(spark, folder):
    """Which brands collect most matching reviews of the fitting mood?"""
    return analytics.review_analytics(
        views.reviews(spark, folder), views.products(spark, folder), C.query_table(spark, _WEIGHTED_REVIEWS), "weighted"
    ).brands


@register("p06_review_reports_weighted", f"""
    WITH {_WEIGHTED_REVIEW_SQL}
    SELECT query_id, 'category' AS report, category AS value, count(*) AS n, CAST(NULL AS DOUBLE) AS avg_rating FROM fitting GROUP BY 1, 3
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n DESC, value) <= 10
    UNION ALL SELECT query_id, 'rating', CAST(rating AS VARCHAR), count(*), NULL FROM fitting GROUP BY 1, rating
    UNION ALL SELECT query_id, 'summary', NULL, count(*), CAST(round(CAST(avg(rating) AS DECIMAL(30, 12)), 2) AS DOUBLE) FROM fitting GROUP BY 1""")
def review_reports_weighted(spark, folder):
    """The other three reports of the same matches."""
    found = analytics.review_analytics(
        views.reviews(spark, folder), views.products(spark, folder), C.query_table(spark, _WEIGHTED_REVIEWS), "weighted")
    none, text = F.lit(None).cast("double").alias("avg_rating"), F.col("value").cast("string").alias("value")
    return (
        found.categories.select("query_id", F.lit("category").alias("report"), text, F.col("negative_review_count").alias("n"), none)
        .unionByName(found.ratings.select("query_id", F.lit("rating").alias("report"), text, "n", none))
        .unionByName(found.summary.select(
            "query_id", F.lit("summary").alias("report"), F.lit(None).cast("string").alias("value"),
            F.col("matched_negative_reviews").alias("n"), "avg_rating"))
    )


@register("p06_review_analytics_lucene", f"""
    WITH {_review_match_sql(_ANALYTIC_QUERIES, False)},
    rows AS (SELECT f.*, coalesce(p.brand, 'Unknown') AS brand, coalesce(p.category, 'Electronics') AS category FROM fitting f LEFT JOIN v_products p ON p.product_id = f.product_id),
    every AS (SELECT query_id, unnest(generate_series(CAST(min(rating) AS INT), CAST(max(rating) AS INT))) AS b FROM rows GROUP BY 1),
    long AS (
      SELECT query_id, 'brand' AS facet, brand AS value, count(*) AS n, round_even(avg(rating), 2) AS avg_rating, CAST(sum(helpful_vote) AS BIGINT) AS helpful_votes FROM rows GROUP BY 1, 3
      UNION ALL SELECT query_id, 'category', category, count(*), round_even(avg(rating), 2), CAST(sum(helpful_vote) AS BIGINT) FROM rows GROUP BY 1, 3
      UNION ALL SELECT query_id, 'summary', NULL, count(*), round_even(avg(rating), 2), CAST(sum(helpful_vote) AS BIGINT) FROM rows GROUP BY 1)
    SELECT * FROM long QUALIFY facet = 'summary' OR row_number() OVER (PARTITION BY query_id, facet ORDER BY n DESC,
      CASE WHEN facet = 'brand' THEN avg_rating END NULLS FIRST, value) <= 10
    UNION ALL SELECT e.query_id, 'rating', CAST(e.b AS VARCHAR) || '.0', count(r.rating), round_even(avg(r.rating), 2), CAST(coalesce(sum(r.helpful_vote), 0) AS BIGINT)
    FROM every e LEFT JOIN rows r ON r.query_id = e.query_id AND floor(r.rating) = e.b GROUP BY e.query_id, e.b""")
def review_analytics_lucene(spark, folder):
    """All four reports of the relevance match."""
    from shelfsift.operators.facets import analytics_bundle

    rows, _ = analytics.matched_reviews(
        views.reviews(spark, folder), views.products(spark, folder), C.query_table(spark, _ANALYTIC_QUERIES), "lucene", PRODUCT
    )
    return analytics_bundle(rows)


@register("p06_review_analytics_ladder", f"""
    WITH {_review_ladder_sql(_ANALYTIC_QUERIES)},
    rows AS (SELECT f.*, coalesce(p.brand, 'Unknown') AS brand FROM fitting f LEFT JOIN v_products p ON p.product_id = f.product_id),
    sample AS (SELECT * FROM rows QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {_VOTES_ORDER}) <= 1000),
    counts AS (SELECT query_id, brand AS value, count(*) AS negative_review_count FROM rows GROUP BY 1, 2
               QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY negative_review_count DESC, value) <= 10),
    metrics AS (SELECT query_id, brand AS value, round_even(avg(rating), 2) AS avg_rating, CAST(sum(helpful_vote) AS BIGINT) AS v FROM sample GROUP BY 1, 2)
    SELECT c.query_id, c.value, c.negative_review_count, m.avg_rating, coalesce(m.v, 0) AS total_helpful_votes
    FROM counts c LEFT JOIN metrics m ON m.query_id = c.query_id AND m.value = c.value""")
def review_analytics_ladder(spark, folder):
    """Exact counts, averages of the first thousand hits."""
    return analytics.review_analytics(
        views.reviews(spark, folder), views.products(spark, folder), C.query_table(spark, _ANALYTIC_QUERIES), "ladder"
    ).brands


# Autocomplete, semantic comparison, overall analytics -----------------------------------------------


@register("p07_autocomplete", f"""
    WITH {C.queries_sql([(1, 'sm'), (2, 'r')])}, {PRODUCTS_SQL}, hits AS (
      SELECT query_id, product_id, title,
        -- One word asks one field for one prefix, and the pairs and triples of words for none.
        row_number() OVER (PARTITION BY query_id ORDER BY product_id) AS r
      FROM queries, (SELECT *, {C.tokens_sql('title')} AS t FROM v_products)
      WHERE len([w for w in t if starts_with(w, q)]) > 0 QUALIFY r <= 5)
    SELECT query_id, title, row_number() OVER (PARTITION BY query_id ORDER BY min(r)) AS rank FROM hits WHERE query_id = 1 GROUP BY 1, 2""")
def autocomplete_titles(spark, folder):
    """Titles of the first five hits from the stored words of the titles; a single letter gets none."""
    products, path = views.products(spark, folder), scratch_path(spark, "title-index")
    autocomplete.title_index(products).save(path)
    kept = search.SearchIndex(titles=TextIndex.load(spark, path, suggest.suggest_fields()))
    rows = autocomplete.suggest_titles(products, C.query_table(spark, [(1, "sm"), (2, "r")]), stored=kept)
    return rows.withColumn("rank", F.col("rank").cast("long"))


@register("p08_semantic_comparison", f"""
    WITH queries AS (SELECT item_id AS query_id, text AS q FROM benchmark), {C.DOCUMENT_POSTINGS_SQL}, {C.query_terms_sql([('text', True)])}, {C.bm25_sql()},
    {X.hashed_sql('d_sparse', 'documents', 'doc_id', 'text', 256)}, {X.hashed_sql('q_sparse', 'queries', 'query_id', 'q', 256)},
    {X.dense_sql('vectors', 'd_sparse', 'doc_id', 'v', 256)}, {X.dense_sql('asked', 'q_sparse', 'query_id', 'q', 256)},
    {X.candidates_sql('vectors', 'asked', 256)},
    scored AS (SELECT query_id, doc_id, round(max(score), 6) AS score FROM field_scores
               WHERE matched >= CASE WHEN n_terms <= 2 THEN n_terms ELSE floor(round(n_terms * 0.7, 9)) END GROUP BY 1, 2)
    SELECT 'semantic' AS section, query_id, doc_id, CAST(((1000000 + CAST(round(c * 1000000) AS BIGINT) + 1) // 2 + 50) // 100 AS DOUBLE) / 10000 AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM near
    UNION ALL SELECT 'keyword', query_id, doc_id, round(score, 4), rank, total FROM ({M._page_sql('scored')})""")
def semantic_comparison(spark, folder):
    """Documents by hashed vectors, candidates only, next to keyword matches."""
    from shelfsift.operators import vectors

    docs = table(spark, folder, "documents")
    # Signatures and exact comparisons both read the vectors.
    embedded = materialized(vectors.dense(vectors.hashed_features(docs, "doc_id", "text", 256), 256))
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    rows = semantic.semantic_and_keyword(C.document_index(spark, folder), embedded, queries, {}, 10, 256, approximate=True)
    return rows.withColumn("score", F.round("score", 4)).withColumn("rank", F.col("rank").cast("long"))


@register("p09_overall_analytics", f"""
    WITH {PRODUCTS_SQL}, {REVIEWS_SQL}, agg AS (
      SELECT product_id, count(*) AS c, round_even(sum(rating) / count(*), 2) AS a, sum(helpful_vote) AS h FROM v_reviews GROUP BY 1),
    e AS (SELECT round_even(avg(coalesce(a, 0)), 2) AS a, sum(coalesce(c, 0)) AS c, sum(coalesce(h, 0)) AS h FROM v_products p LEFT JOIN agg ON agg.product_id = p.product_id),
    r AS (SELECT CAST(round(CAST(avg(rating) AS DECIMAL(30, 12)), 2) AS DOUBLE) AS a, count(*) AS c, sum(helpful_vote) AS h FROM v_reviews)
    SELECT 'lucene' AS engine, 'avg_rating' AS metric, CAST(a AS DOUBLE) AS value FROM e UNION ALL SELECT 'lucene', 'review_count', CAST(c AS DOUBLE) FROM e
    UNION ALL SELECT 'lucene', 'helpful_votes', CAST(h AS DOUBLE) FROM e UNION ALL SELECT 'weighted', 'avg_rating', a FROM r
    UNION ALL SELECT 'weighted', 'review_count', CAST(c AS DOUBLE) FROM r UNION ALL SELECT 'weighted', 'helpful_votes', CAST(h AS DOUBLE) FROM r
    UNION ALL SELECT 'ladder', 'product_count', CAST(count(*) AS DOUBLE) FROM v_products
    UNION ALL SELECT 'ladder', 'rating=' || printf('%.1f', rating), CAST(count(*) AS DOUBLE) FROM v_products GROUP BY rating""")
def overall_analytics(spark, folder):
    from shelfsift.operators import enrich, review_stats

    reviews = views.reviews(spark, folder)
    products = enrich.enrich_products(
        views.products(spark, folder).select("product_id", "title", "rating"), review_stats.review_aggregates(reviews)
    )
    return analytics.overall_analytics(products, reviews)
