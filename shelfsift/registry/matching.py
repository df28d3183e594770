"""Term, fuzzy and trigram joins, matching and ranking (D5-D8, F1-F12, F17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsift.functions.filters import ProductFilter
from shelfsift.functions.text import PLAIN_WORDS, PRODUCT
from shelfsift.operators import fuzzy, ladder, limits, match, postings, rank, suggest, trigram
from shelfsift.registry import register
from shelfsift.registry import corpora as C
from shelfsift.sources import views
from shelfsift.sources.views import PRODUCTS_SQL, table

_TEXT = [("text", True)]
_DOC_SQL = f"{C.queries_sql(C.DOCUMENT_QUERIES)}, {C.DOCUMENT_POSTINGS_SQL}, {C.query_terms_sql(_TEXT)}"
_PRODUCT_SQL = f"{C.queries_sql(C.PRODUCT_QUERIES)}, {C.PRODUCT_POSTINGS_SQL}, {C.query_terms_sql(C.PRODUCT_FIELDS_SQL)}"


def _page(scores, k=10):
    """Top hits with rank and total."""
    page = limits.page_with_total(scores, k, [F.desc("score"), F.asc("doc_id")])
    return page.select("query_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"), "total")


def _page_sql(scores: str, k: int = 10) -> str:
    return f"""SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank,
           count(*) OVER (PARTITION BY query_id) AS total FROM {scores} QUALIFY rank <= {k}"""


@register("d05_rows_by_one_query_row", f"""
    WITH {PRODUCTS_SQL} SELECT product_id, title FROM v_products
    WHERE list_contains({C.tokens_sql('title')}, 'red') AND list_contains({C.tokens_sql('title')}, 'widget')""")
def rows_by_one_query_row(spark, folder):
    """A one-row query table meets the rows through its terms, not through a product of both."""
    queries = C.query_table(spark, C.PRODUCT_QUERIES[:1])
    products = views.products(spark, folder)
    positions = postings.term_positions(products, [postings.IndexField("title")], "product_id")
    found = match.matching_documents(positions, match.query_units(queries, PRODUCT))
    return products.join(found.select(F.col("doc_id").alias("product_id")), "product_id").select("product_id", "title")


@register("d06_term_join", f"""
    WITH {_DOC_SQL} SELECT q.query_id, q.slot, p.doc_id, p.term, p.pos, p.dl
    FROM posts p JOIN qterms q ON q.field = p.field AND q.term = p.term""")
def term_join(spark, folder):
    """Every posting of every query term."""
    terms = postings.query_terms(C.query_table(spark, C.DOCUMENT_QUERIES), C.DOCUMENT_FIELDS)
    positions = C.document_index(spark, folder).positions
    return positions.join(terms, ["field", "term"]).select("query_id", "slot", "doc_id", "term", "pos", "dl")


_SPELLED = [(1, "wiht"), (2, "fromm"), (3, "thier"), (4, "hte"), (5, "of")]


def _expanded_sql(queries: str, prefix: int, edits: str = "auto", cap: int | None = None) -> str:
    """CTE ``qterms`` with the spellings of every query term."""
    allowed = {
        "auto": "CASE WHEN length(q.term) <= 2 THEN 0 WHEN length(q.term) <= 5 THEN 1 ELSE 2 END",
        "ladder": "CASE WHEN length(q.term) < 5 THEN 0 WHEN length(q.term) < 9 THEN 1 ELSE 2 END",
    }[edits]
    guard = f"AND substring(q.term, 1, {prefix}) = substring(v.term, 1, {prefix})" if prefix else ""
    limit = f"QUALIFY row_number() OVER (PARTITION BY field, q_term ORDER BY typos, term) <= {cap}" if cap else ""
    return f"""vocab AS (SELECT DISTINCT field, term FROM posts),
    near AS (
      SELECT * FROM (SELECT DISTINCT q.field, q.term AS q_term, v.term, damerau_levenshtein(q.term, v.term) AS typos
      FROM {queries} q JOIN vocab v ON v.field = q.field AND abs(length(v.term) - length(q.term)) <= 2
      WHERE damerau_levenshtein(q.term, v.term) <= {allowed} {guard}) {limit}),
    qterms AS (
      SELECT q.query_id, q.field, q.slot, q.n_terms, n.term, CAST(n.typos AS INT) AS typos,
             1 - n.typos / CAST(least(length(n.q_term), length(n.term)) AS DOUBLE) AS weight
      FROM {queries} q JOIN near n ON n.field = q.field AND n.q_term = q.term)"""


@register("d07_fuzzy_term_join", f"""
    WITH {C.queries_sql(_SPELLED)}, {C.DOCUMENT_POSTINGS_SQL}, {C.query_terms_sql(_TEXT, name='raw_terms')},
    {_expanded_sql('raw_terms', 1, cap=None)}
    SELECT query_id, term, typos, round(weight, 6) AS weight FROM qterms""")
def fuzzy_term_join(spark, folder):
    """All spellings in the vocabulary of the documents, first letter fixed."""
    terms = postings.query_terms(C.query_table(spark, _SPELLED), C.DOCUMENT_FIELDS)
    vocab = postings.vocabulary(C.document_index(spark, folder))
    found = fuzzy.expand_terms(terms, vocab, prefix_length=1, max_expansions=None)
    return found.select("query_id", "term", "typos", F.round("weight", 6).alias("weight"))


_GRAM_QUERIES = [(1, "red widgte"), (2, "hot gear"), (3, "smal rign"), (4, "qqq")]


def _grams_sql(name: str, source: str, id_column: str, text: str) -> str:
    return f"""{name} AS (SELECT DISTINCT id, substring(w, i, 3) AS gram FROM (
      SELECT id, w, unnest(generate_series(1, length(w) - 2)) AS i FROM (
        SELECT {id_column} AS id, '  ' || unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) || ' ' AS w FROM {source})))"""


def _similarity_sql(name: str, grams: str) -> str:
    return f"""{name} AS (
      SELECT q.id AS query_id, d.id AS doc_id, round(count(*) / CAST(any_value(qn.n) + any_value(dn.n) - count(*) AS DOUBLE), 6) AS similarity
      FROM qgrams q JOIN {grams} d ON d.gram = q.gram
      JOIN (SELECT id, count(*) AS n FROM qgrams GROUP BY 1) qn ON qn.id = q.id
      JOIN (SELECT id, count(*) AS n FROM {grams} GROUP BY 1) dn ON dn.id = d.id GROUP BY 1, 2)"""


@register("d08_trigram_join", f"""
    WITH {C.queries_sql(_GRAM_QUERIES)}, {PRODUCTS_SQL}, {_grams_sql('qgrams', 'queries', 'query_id', 'q')},
    {_grams_sql('dgrams', 'v_products', 'product_id', 'description')}, {_similarity_sql('sims', 'dgrams')}
    SELECT query_id, doc_id, similarity FROM sims""")
def trigram_join(spark, folder):
    """Similarity of every pair of query and description that share a trigram."""
    return trigram.similarity(views.products(spark, folder), "product_id", "description", C.query_table(spark, _GRAM_QUERIES))


_DOC_SCORES = "scored AS (SELECT query_id, doc_id, round(max(score), 6) AS score FROM field_scores GROUP BY 1, 2)"


@register("f01_any_term_relevance", f"""
    WITH {_DOC_SQL}, {C.bm25_sql()}, {_DOC_SCORES} {_page_sql('scored', 50)}""")
def any_term_relevance(spark, folder):
    """Relevance of documents with at least one query word."""
    index = C.document_index(spark, folder)
    terms = postings.query_terms(C.query_table(spark, C.DOCUMENT_QUERIES), index.fields)
    return _page(match.any_term_match(index, terms), 50)


_BOOSTED = f"scored AS (SELECT query_id, doc_id, round(max(score * {C.boost_sql(C.PRODUCT_BOOSTS)}), 6) AS score FROM field_scores GROUP BY 1, 2)"


@register("f02_boosted_best_field", f"""
    WITH {_PRODUCT_SQL}, {C.bm25_sql()}, {_BOOSTED} {_page_sql('scored')}""")
def boosted_best_field(spark, folder):
    """Five fields with boosts; the best field of a product counts."""
    index = C.product_index(spark, folder)
    terms = postings.query_terms(C.query_table(spark, C.PRODUCT_QUERIES), index.fields)
    return _page(match.any_term_match(index, terms, C.PRODUCT_BOOSTS))


@register("f03_fuzzy_boosted_match", f"""
    WITH {C.queries_sql(C.MISSPELT_QUERIES)}, {C.PRODUCT_POSTINGS_SQL}, {C.query_terms_sql(C.PRODUCT_FIELDS_SQL, name='raw_terms')},
    {_expanded_sql('raw_terms', 1)}, {C.bm25_sql()}, {_BOOSTED} {_page_sql('scored')}""")
def fuzzy_boosted_match(spark, folder):
    """Misspelt product queries, first letter fixed."""
    index = C.product_index(spark, folder)
    terms = postings.query_terms(C.query_table(spark, C.MISSPELT_QUERIES), index.fields)
    spelled = fuzzy.expand_terms(terms, postings.vocabulary(index), prefix_length=1)
    return _page(match.any_term_match(index, spelled, C.PRODUCT_BOOSTS))


@register("f04_minimum_should_match", f"""
    WITH queries AS (SELECT item_id AS query_id, text AS q FROM benchmark), {C.DOCUMENT_POSTINGS_SQL}, {C.query_terms_sql(_TEXT)}, {C.bm25_sql()},
    scored AS (SELECT query_id, doc_id, round(max(score), 6) AS score FROM field_scores
               WHERE matched >= CASE WHEN n_terms <= 2 THEN n_terms ELSE floor(round(n_terms * 0.7, 9)) END GROUP BY 1, 2)
    {_page_sql('scored')}""")
def minimum_should_match(spark, folder):
    """Every benchmark passage as a query; seven tenths of its words must occur."""
    index = C.document_index(spark, folder)
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    return _page(match.best_field(match.minimum_match_scores(index, postings.query_terms(queries, index.fields))))


_TYPED = [(1, "sm"), (2, "red wi"), (3, "small ring"), (4, "blue w")]


@register("f05_search_as_you_type", f"""
    WITH {C.queries_sql(_TYPED)}, {PRODUCTS_SQL},
    posts_docs AS (
      SELECT product_id AS doc_id, 'title' AS field, {C.tokens_sql('title')} AS toks FROM v_products
      UNION ALL SELECT product_id, 'title._2gram', [t[i] || ' ' || t[i+1] for i in range(1, len(t))] FROM (SELECT product_id, {C.tokens_sql('title')} AS t FROM v_products)
      UNION ALL SELECT product_id, 'title._3gram', [t[i] || ' ' || t[i+1] || ' ' || t[i+2] for i in range(1, len(t) - 1)] FROM (SELECT product_id, {C.tokens_sql('title')} AS t FROM v_products)),
    posts AS (SELECT doc_id, field, unnest(toks) AS term, len(toks) AS dl FROM posts_docs),
    posts_stats AS (SELECT field, count(*) AS n_docs, avg(len(toks)) AS avg_dl FROM posts_docs WHERE len(toks) > 0 GROUP BY 1),
    qlists AS (
      SELECT query_id, 'title' AS field, t FROM (SELECT query_id, {C.tokens_sql('q')} AS t FROM queries)
      UNION ALL SELECT query_id, 'title._2gram', [t[i] || ' ' || t[i+1] for i in range(1, len(t))] FROM (SELECT query_id, {C.tokens_sql('q')} AS t FROM queries)
      UNION ALL SELECT query_id, 'title._3gram', [t[i] || ' ' || t[i+1] || ' ' || t[i+2] for i in range(1, len(t) - 1)] FROM (SELECT query_id, {C.tokens_sql('q')} AS t FROM queries)),
    qall AS (SELECT query_id, field, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS slot, len(t) AS n_terms, CAST(1 AS DOUBLE) AS weight FROM qlists),
    qterms AS (SELECT * FROM qall WHERE slot < n_terms - 1), {C.bm25_sql()},
    begun AS (SELECT DISTINCT q.query_id, p.doc_id, p.field, CAST(1 AS DOUBLE) AS score FROM qall q JOIN posts p
              ON p.field = q.field AND starts_with(p.term, q.term) WHERE q.slot = q.n_terms - 1),
    scored AS (SELECT query_id, doc_id, round(sum(score), 6) AS score FROM (
      SELECT query_id, doc_id, field, score FROM field_scores UNION ALL SELECT * FROM begun) GROUP BY 1, 2)
    {_page_sql('scored', 20)}""")
def search_as_you_type(spark, folder):
    """The last word is a prefix; words, pairs and triples of the title add up."""
    index = postings.TextIndex.of(views.products(spark, folder), suggest.suggest_fields(), "product_id")
    return _page(suggest.prefix_search(index, C.query_table(spark, _TYPED)), 20)


@register("f06_suggestions", f"""
    WITH {C.queries_sql([(1, 's'), (2, 'sm'), (3, 're'), (4, 'gea')])}, {PRODUCTS_SQL}, hits AS (
      SELECT query_id, product_id, title, row_number() OVER (PARTITION BY query_id ORDER BY rating DESC, review_count DESC, product_id) AS r
      FROM queries, v_products WHERE len([w for w in {C.tokens_sql('title')} if starts_with(w, q)]) > 0)
    SELECT query_id, title, row_number() OVER (PARTITION BY query_id ORDER BY min(r)) AS rank
    FROM hits WHERE query_id > 1 GROUP BY query_id, title QUALIFY rank <= 5""")
def title_suggestions(spark, folder):
    """Distinct titles in hit order; a single letter suggests nothing."""
    products = views.products(spark, folder)
    queries = C.query_table(spark, [(1, "s"), (2, "sm"), (3, "re"), (4, "gea")])
    index = postings.TextIndex.of(products, suggest.suggest_fields()[:1], "product_id")
    found = suggest.prefix_search(index, queries)
    shown = products.select(F.col("product_id").alias("doc_id"), "title", "rating", "review_count")
    rated = found.join(shown, "doc_id")
    # Whole hit list: distinct titles may lie anywhere in it, so titles are reduced before they are ranked.
    order = F.struct((-F.col("rating")).alias("a"), (-F.col("review_count")).alias("b"), F.col("doc_id").alias("c"))
    ranked = rated.groupBy("query_id", "title").agg(F.min(order).alias("rank"))
    rows = suggest.suggestions(ranked, queries)
    return rows.withColumn("rank", F.col("rank").cast("long"))


_BOOLEAN = [
    (1, "with from"), (2, "with or this"), (3, "with -from"), (4, '"of the"'), (5, 'with "of the" -this'),
    (6, "-the"), (7, 'from -"of the" or this that'), (8, "words-nobody-wrote"),
]


@register("f07_boolean_phrase_match", f"""
    WITH docs AS (SELECT doc_id, {C.tokens_sql('text')} AS t FROM documents),
    f AS (SELECT doc_id, list_contains(t, 'with') AS a, list_contains(t, 'from') AS b, list_contains(t, 'this') AS c,
                 list_contains(t, 'the') AS d, list_contains(t, 'that') AS e,
                 contains('|' || array_to_string(t, '|') || '|', '|of|the|') AS p FROM docs)
    SELECT 1 AS query_id, doc_id FROM f WHERE a AND b UNION ALL SELECT 2, doc_id FROM f WHERE a OR c
    UNION ALL SELECT 3, doc_id FROM f WHERE a AND NOT b UNION ALL SELECT 4, doc_id FROM f WHERE p
    UNION ALL SELECT 5, doc_id FROM f WHERE a AND p AND NOT c UNION ALL SELECT 6, doc_id FROM f WHERE NOT d
    UNION ALL SELECT 7, doc_id FROM f WHERE (b AND NOT p) OR (c AND e)""")
def boolean_phrase_match(spark, folder):
    """All words, alternatives, exclusions, phrases, and a query that only excludes."""
    docs = table(spark, folder, "documents")
    units = match.query_units(C.query_table(spark, _BOOLEAN), PRODUCT)
    return match.matching_documents(C.document_index(spark, folder).positions, units, docs.select("doc_id"))


_ECONOMY = [(1, "economy"), (2, "red widget"), (3, "small ring economy")]
_CHAINED_SQL = f"""{C.queries_sql(_ECONOMY)}, {PRODUCTS_SQL}, t AS (
      SELECT product_id, {C.tokens_sql('title')} AS a, {C.tokens_sql('brand', False)} AS b, {C.tokens_sql('category', False)} AS c,
             {C.tokens_sql('features')} AS d, {C.tokens_sql('description')} AS e FROM v_products),
    chained AS (
      SELECT product_id AS doc_id, unnest(a) AS term, generate_subscripts(a, 1) AS pos, CAST(1.0 AS DOUBLE) AS weight FROM t
      UNION ALL SELECT product_id, unnest(b), len(a) + generate_subscripts(b, 1), 0.4 FROM t
      UNION ALL SELECT product_id, unnest(c), len(a) + len(b) + generate_subscripts(c, 1), 0.4 FROM t
      UNION ALL SELECT product_id, unnest(d), len(a) + len(b) + len(c) + generate_subscripts(d, 1), 0.4 FROM t
      UNION ALL SELECT product_id, unnest(e), len(a) + len(b) + len(c) + len(d) + generate_subscripts(e, 1), 0.2 FROM t),
    words AS (SELECT DISTINCT query_id, unnest({C.tokens_sql('q')}) AS term FROM queries),
    counts AS (SELECT query_id, count(*) AS n_terms FROM words GROUP BY 1),
    hits AS (SELECT w.query_id, c.doc_id, c.term, c.pos, c.weight, n.n_terms FROM chained c JOIN words w ON w.term = c.term JOIN counts n ON n.query_id = w.query_id),
    full_match AS (SELECT query_id, doc_id FROM hits GROUP BY 1, 2 HAVING count(DISTINCT term) = any_value(n_terms))"""


def weighted_positions(spark, folder):
    classes = {k: v for k, v in match.PRODUCT_CLASSES.items() if k != "review_text"}
    return postings.term_positions(
        views.products(spark, folder), match.weighted_fields(classes, PLAIN_WORDS), "product_id", chained=True
    )


@register("f08_weighted_frequency_rank", f"""
    WITH {_CHAINED_SQL},
    nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, term ORDER BY weight DESC, pos) AS i FROM hits),
    scored AS (SELECT query_id, doc_id, round(sum(weight / (i * i)) / any_value(n_terms), 6) AS score FROM nth
               WHERE (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM full_match) GROUP BY 1, 2)
    {_page_sql('scored')}""")
def weighted_frequency_rank(spark, folder):
    """Class weights fall with the square of the occurrence number."""
    positions = weighted_positions(spark, folder)
    units = match.query_units(C.query_table(spark, _ECONOMY), PLAIN_WORDS)
    scores = rank.frequency_rank(positions, match.ranked_slots(units))
    return _page(scores.join(match.matching_documents(positions, units), ["query_id", "doc_id"], "left_semi"))


@register("f09_cover_density_rank", f"""
    WITH {_DOC_SQL}, words AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY term) AS slot,
                               count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT DISTINCT query_id, term FROM qterms)),
    hits AS (SELECT w.query_id, p.doc_id, p.pos, w.slot, w.n FROM posts p JOIN words w ON w.term = p.term),
    last AS (SELECT query_id, doc_id, pos, n,
               max(CASE WHEN slot = 1 THEN pos END) OVER w AS a, max(CASE WHEN slot = 2 THEN pos END) OVER w AS b,
               max(CASE WHEN slot = 3 THEN pos END) OVER w AS c
             FROM hits WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY pos)),
    spans AS (SELECT query_id, doc_id, least(a, b, c) AS s, min(pos) AS e FROM last
              WHERE (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT = n GROUP BY 1, 2, 3),
    scored AS (SELECT query_id, doc_id, round(sum(1 / CAST(e - s + 1 AS DOUBLE)), 6) AS score FROM spans GROUP BY 1, 2)
    {_page_sql('scored', 50)}""")
def cover_density_rank(spark, folder):
    """One over the length of every shortest span with all words."""
    units = match.query_units(C.query_table(spark, C.DOCUMENT_QUERIES), PRODUCT)
    positions = C.document_index(spark, folder).positions
    return _page(rank.cover_rank(positions, match.ranked_slots(units), weighted=False), 50)


@register("f09_cover_density_weighted", f"""
    WITH {_CHAINED_SQL},
    slots AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY term) AS slot FROM hits),
    last AS (SELECT query_id, doc_id, pos, n_terms,
               max(CASE WHEN slot = 1 THEN {{'p': pos, 'w': weight}} END) OVER w AS a, max(CASE WHEN slot = 2 THEN {{'p': pos, 'w': weight}} END) OVER w AS b,
               max(CASE WHEN slot = 3 THEN {{'p': pos, 'w': weight}} END) OVER w AS c
             FROM slots WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY pos)),
    complete AS (SELECT query_id, doc_id, least(a.p, b.p, c.p) AS s, pos AS e,
                   n_terms / (coalesce(1 / a.w, 0) + coalesce(1 / b.w, 0) + coalesce(1 / c.w, 0)) AS hm
                 FROM last WHERE (a.p IS NOT NULL)::INT + (b.p IS NOT NULL)::INT + (c.p IS NOT NULL)::INT = n_terms),
    spans AS (SELECT query_id, doc_id, s, min(e) AS e, arg_min(hm, e) AS hm FROM complete GROUP BY 1, 2, 3),
    scored AS (SELECT query_id, doc_id, round(sum(hm / (e - s + 1)), 6) AS score FROM spans GROUP BY 1, 2)
    {_page_sql('scored', 20)}""")
def cover_density_weighted(spark, folder):
    """Spans across the chained product fields, scaled by their class weights."""
    units = match.query_units(C.query_table(spark, _ECONOMY), PLAIN_WORDS)
    return _page(rank.cover_rank(weighted_positions(spark, folder), match.ranked_slots(units)), 20)


@register("f10_trigram_match", f"""
    WITH {C.queries_sql(_GRAM_QUERIES)}, {_grams_sql('qgrams', 'queries', 'query_id', 'q')}, {_grams_sql('dgrams', 'part', 'p_partkey', 'p_name')},
    {_similarity_sql('sims', 'dgrams')}
    SELECT query_id, doc_id, similarity FROM sims WHERE similarity >= 0.3""")
def trigram_match(spark, folder):
    return trigram.similar(table(spark, folder, "part"), "p_partkey", "p_name", C.query_table(spark, _GRAM_QUERIES))


_COMPOSITE = [(1, "red widgte"), (2, "hot gear"), (3, "economy"), (4, "small ring -red")]
_COMPOSITE_FILTER = ProductFilter(min_price=20, max_price=350, min_rating=2)


@register("f11_composite_basic_search", f"""
    WITH {_CHAINED_SQL.replace(C.queries_sql(_ECONOMY), C.queries_sql([(1, 'red widgte'), (2, 'hot gear'), (3, 'economy'), (4, 'small ring')]))},
    raw_queries AS (SELECT query_id, CASE WHEN query_id = 4 THEN q || ' -red' ELSE q END AS q FROM queries),
    {_grams_sql('qgrams', 'raw_queries', 'query_id', 'q')}, {_grams_sql('tgrams', 'v_products', 'product_id', 'title')},
    {_grams_sql('dgrams', 'v_products', 'product_id', 'description')}, {_similarity_sql('tsims', 'tgrams')}, {_similarity_sql('dsims', 'dgrams')},
    matched AS (SELECT * FROM full_match WHERE query_id < 4 OR doc_id NOT IN (SELECT product_id FROM v_products WHERE list_contains({C.tokens_sql('title')}, 'red'))),
    nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id, term ORDER BY weight DESC, pos) AS i FROM hits),
    ranked AS (SELECT query_id, doc_id, round(sum(weight / (i * i)) / any_value(n_terms), 6) AS rank_score FROM nth
               WHERE (query_id, doc_id) IN (SELECT (query_id, doc_id) FROM matched) GROUP BY 1, 2),
    parts AS (SELECT coalesce(r.query_id, t.query_id, d.query_id) AS query_id, coalesce(r.doc_id, t.doc_id, d.doc_id) AS doc_id,
                     r.rank_score, t.similarity AS ts, d.similarity AS ds
              FROM ranked r FULL JOIN tsims t ON t.query_id = r.query_id AND t.doc_id = r.doc_id
              FULL JOIN dsims d ON d.query_id = coalesce(r.query_id, t.query_id) AND d.doc_id = coalesce(r.doc_id, t.doc_id)),
    scored AS (SELECT p.query_id, p.doc_id, round(coalesce(rank_score, 0) + coalesce(ts, 0), 6) AS score, v.rating, v.review_count
               FROM parts p JOIN v_products v ON v.product_id = p.doc_id
               WHERE (rank_score IS NOT NULL OR ts >= 0.3 OR ds >= 0.3) AND v.price BETWEEN 20 AND 350 AND v.rating >= 2)
    SELECT query_id, doc_id, score, rating, review_count,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rating DESC, review_count DESC, doc_id) AS rank
    FROM scored QUALIFY rank <= 10""")
def composite_basic_search(spark, folder):
    """Text match or trigram match, filters, and the sum of rank and title similarity."""
    from shelfsift.plans.search import weighted_basic_hits

    hits, _ = weighted_basic_hits(
        views.products(spark, folder), weighted_positions(spark, folder), C.query_table(spark, _COMPOSITE),
        PLAIN_WORDS, _COMPOSITE_FILTER, 10,
    )
    return hits.select("query_id", "doc_id", "score", "rating", "review_count", F.col("rank").cast("long").alias("rank"))


def ladder_sql(raw_terms: str, slots: int = 2, posts: str = "posts") -> str:
    """CTE ``ladder_rows`` (query_id, doc_id, words, typos, span, attribute, exact, score)."""
    last = ", ".join(f"max(CASE WHEN slot = {i} THEN pos END) OVER w AS s{i}" for i in range(slots))
    starts = ", ".join(f"s{i}" for i in range(slots))
    seen = " + ".join(f"(s{i} IS NOT NULL)::INT" for i in range(slots))
    spelled = _expanded_sql(raw_terms, 0, "ladder", None).replace("qterms AS (", "lterms AS (")
    span = "coalesce(s.span, 1000000)"
    return f"""{spelled},
    lhits AS (SELECT q.query_id, p.doc_id, p.field, p.field_no, p.pos, q.slot, q.typos, q.n_terms FROM {posts} p
              JOIN lterms q ON q.field = p.field AND q.term = p.term),
    lslots AS (SELECT query_id, doc_id, slot, n_terms, min(typos) AS typos, min(field_no) AS attribute FROM lhits GROUP BY 1, 2, 3, 4),
    lwords AS (SELECT query_id, doc_id, n_terms, count(*) AS words, CAST(sum(typos) AS BIGINT) AS typos, min(attribute) AS attribute,
                      count(*) FILTER (typos = 0) AS exact FROM lslots GROUP BY 1, 2, 3),
    llast AS (SELECT query_id, doc_id, field, pos, n_terms, {last} FROM lhits WINDOW w AS (PARTITION BY query_id, doc_id, field ORDER BY pos)),
    lspans AS (SELECT query_id, doc_id, min(pos - least({starts}) + 1) AS span FROM llast WHERE {seen} = n_terms GROUP BY 1, 2),
    ladder_rows AS (
      SELECT w.query_id, w.doc_id, w.words, w.typos, {span} AS span, w.attribute, w.exact,
             round((w.words - 1 + (2 * w.n_terms - w.typos + 1 / CAST(1 + {span} AS DOUBLE)) / (2 * w.n_terms + 1)) / w.n_terms, 6) AS score
      FROM lwords w LEFT JOIN lspans s ON s.query_id = w.query_id AND s.doc_id = w.doc_id)"""


LADDER_ORDER_SQL = "words DESC, typos, span, attribute, exact DESC, doc_id"
MISSPELT_LADDER_SQL = f"""{C.queries_sql(C.MISSPELT_QUERIES)}, {C.PRODUCT_POSTINGS_SQL}, {C.query_terms_sql(C.PRODUCT_FIELDS_SQL, name='raw_terms')},
    {ladder_sql('raw_terms')}"""


@register("f12_ladder_search", f"""
    WITH {MISSPELT_LADDER_SQL}
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {LADDER_ORDER_SQL}) AS rank FROM ladder_rows QUALIFY rank <= 20""")
def ladder_search(spark, folder):
    """Misspelt product queries ranked by words, typos, closeness, attribute and exactness."""
    index = C.product_index(spark, folder)
    found = ladder.ladder_matches(index, ladder.ladder_terms(index, C.query_table(spark, C.MISSPELT_QUERIES)))
    page = limits.top_k(found, 20, ladder.ladder_order())
    return page.drop("n_terms").withColumn("rank", F.col("rank").cast("long"))


@register("f17_total_variants", f"""
    WITH {_DOC_SQL}, {C.bm25_sql()}, {_DOC_SCORES},
    page AS ({_page_sql('scored')})
    SELECT query_id, any_value(total) AS total, count(*) AS returned, least(any_value(total), 100) AS capped FROM page GROUP BY 1""")
def total_variants(spark, folder):
    """All matches, the rows returned, and the total with a cap."""
    index = C.document_index(spark, folder)
    terms = postings.query_terms(C.query_table(spark, C.DOCUMENT_QUERIES), index.fields)
    page = _page(match.any_term_match(index, terms))
    return page.groupBy("query_id").agg(
        F.max("total").alias("total"), F.count(F.lit(1)).alias("returned"),
        F.least(F.max("total"), F.lit(100).cast("long")).alias("capped"),
    )
