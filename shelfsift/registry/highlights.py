"""Highlights, snippets and hit assembly (H, B11, B13, B15), side-by-side results (U)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsift.functions import display
from shelfsift.functions.text import PLAIN_WORDS, PRODUCT
from shelfsift.operators import highlight, ladder, limits, match, postings
from shelfsift.operators.sizes import materialized
from shelfsift.plans.search import few_hits, overlap, side_by_side
from shelfsift.registry import corpora as C
from shelfsift.registry import matching as M
from shelfsift.registry import register
from shelfsift.sources import views
from shelfsift.sources.views import PRODUCTS_SQL, REVIEWS_SQL, table

_QUERIES = C.DOCUMENT_QUERIES
_TOP_SQL = f"""{M._DOC_SQL}, {C.bm25_sql()}, {M._DOC_SCORES},
    top AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
            FROM scored QUALIFY rank <= 10),
    marks AS (SELECT query_id, list_distinct(list(term)) AS terms FROM qterms GROUP BY 1),
    shown AS (SELECT t.query_id, t.doc_id, t.score, t.rank, d.text, m.terms FROM top t JOIN documents d ON d.doc_id = t.doc_id
              JOIN marks m ON m.query_id = t.query_id)"""


def mark_sql(text: str, tag: str, terms: str = "terms", folded: bool = True) -> str:
    """Words of a text marked, by cutting it into words and gaps."""
    word = C.fold_sql("lower(p)") if folded else "lower(p)"
    return f"""array_to_string([CASE WHEN list_contains({terms}, {word}) THEN '<{tag}>' || p || '</{tag}>' ELSE p END
        for p in regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+')], '')"""


def _shown(spark, folder, source=None):
    """The ten best documents of each query with their text and the words to mark."""
    index = C.document_index(spark, folder)
    queries = C.query_table(spark, _QUERIES)
    terms = postings.query_terms(queries, index.fields)
    page = limits.top_k(match.any_term_match(index, terms), 10, [F.desc("score"), F.asc("doc_id")])
    docs = (source or table(spark, folder, "documents"))
    return highlight.with_source(page, docs, "doc_id", highlight.spelled_terms(terms), few_hits(queries, 10))


@register("h01_mark_whole_field", f"""
    WITH {_TOP_SQL} SELECT query_id, doc_id, {mark_sql('text', 'mark')} AS marked FROM shown""")
def mark_whole_field(spark, folder):
    rows = _shown(spark, folder)
    return rows.select("query_id", "doc_id", highlight.mark_all(F.col("text"), F.col("terms")).alias("marked"))


def fragment_sql(words: int, folded: bool = True) -> str:
    """CTE ``chosen`` (query_id, doc_id, terms, run) of the rows in ``shown``."""
    first = "lower(regexp_extract(x, '[\\p{L}\\p{N}]+'))"
    return f"""pieces AS (SELECT query_id, doc_id, terms, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+[^\\p{{L}}\\p{{N}}]*') AS u FROM shown),
    starts AS (SELECT *, unnest(generate_series(1, greatest(len(u) - {words - 1}, 1))) AS s FROM pieces),
    scored_starts AS (SELECT query_id, doc_id, terms, u, s, len([x for x in u[s:s + {words - 1}]
                      if list_contains(terms, {C.fold_sql(first) if folded else first})]) AS h FROM starts),
    chosen AS (SELECT query_id, doc_id, terms, rtrim(array_to_string(u[s:s + {words - 1}], '')) AS run FROM scored_starts
               QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY h DESC, s) = 1)"""


@register("h02_best_fragment", f"""
    WITH {_TOP_SQL}, {fragment_sql(24)} SELECT query_id, doc_id, {mark_sql('run', 'mark')} AS fragment FROM chosen""")
def best_fragment(spark, folder):
    """The 24 neighbouring words with most query words."""
    rows = _shown(spark, folder)
    return rows.select("query_id", "doc_id", highlight.best_fragment(F.col("text"), F.col("terms"), 24).alias("fragment"))


def _pieces_sql(size: int, count: int, source: str = "shown", text: str = "text") -> str:
    hits = f"len([t for t in {C.tokens_sql('piece')} if list_contains(terms, t)])"
    return f"""cut AS (SELECT query_id, doc_id, terms, regexp_extract_all({text}, '(?s).{{1,{size}}}(?:\\s|\\z)|.{{1,{size}}}') AS ps FROM {source}),
    numbered AS (SELECT query_id, doc_id, terms, unnest(ps) AS piece, generate_subscripts(ps, 1) AS idx FROM cut),
    counted AS (SELECT *, {hits} AS h FROM numbered),
    best AS (SELECT query_id, doc_id, terms, piece, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY h DESC, idx) AS no
             FROM counted WHERE h > 0 QUALIFY no <= {count})"""


@register("h03_character_fragments", f"""
    WITH {_TOP_SQL}, {_pieces_sql(180, 2)} SELECT query_id, doc_id, CAST(no - 1 AS INT) AS no, rtrim({mark_sql('piece', 'em')}) AS fragment FROM best""")
def character_fragments(spark, folder):
    """Two pieces of about 180 characters."""
    pieces = highlight.fragments(F.col("text"), F.col("terms"), 180, 2)
    return _shown(spark, folder).select("query_id", "doc_id", F.posexplode(pieces).alias("no", "fragment"))


_PRODUCT_TOP_SQL = f"""{M._PRODUCT_SQL}, {C.bm25_sql()}, {M._BOOSTED},
    top AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
            FROM scored QUALIFY rank <= 10),
    marks AS (SELECT query_id, list_distinct(list(term)) AS terms FROM qterms GROUP BY 1),
    hits AS (SELECT t.query_id, t.doc_id, t.rank, t.score, v.*, m.terms FROM top t JOIN v_products v ON v.product_id = t.doc_id
             JOIN marks m ON m.query_id = t.query_id)"""


def _product_hits(spark, folder):
    index = C.product_index(spark, folder)
    queries = C.query_table(spark, C.PRODUCT_QUERIES)
    terms = postings.query_terms(queries, index.fields)
    scores = match.any_term_match(index, terms, C.PRODUCT_BOOSTS)
    page = limits.top_k(scores, 10, [F.desc("score"), F.asc("doc_id")])
    marks = highlight.spelled_terms(terms)
    return highlight.with_source(page, views.products(spark, folder), "product_id", marks, few_hits(queries, 10))


@register("h04_field_fragments", f"""
    WITH {_PRODUCT_TOP_SQL}, fields AS (
      SELECT query_id, product_id || ':title' AS doc_id, title AS text, terms FROM hits
      UNION ALL SELECT query_id, product_id || ':features', features, terms FROM hits
      UNION ALL SELECT query_id, product_id || ':description', description, terms FROM hits),
    {_pieces_sql(100, 5, 'fields')}
    SELECT query_id, split_part(doc_id, ':', 1) AS product_id, split_part(doc_id, ':', 2) AS field, no, rtrim({mark_sql('piece', 'em')}) AS fragment FROM best""")
def field_fragments(spark, folder):
    """Default-size pieces on three fields as a map; fields without a hit are absent."""
    rows = _product_hits(spark, folder)
    parts = {n: highlight.fragments(F.col(n), F.col("terms"), 100, 5) for n in ("title", "features", "description")}
    mapped = rows.select("query_id", "product_id", F.explode(highlight.highlight_map(parts)).alias("field", "pieces"))
    return mapped.select("query_id", "product_id", "field", F.posexplode("pieces").alias("no", "fragment")).withColumn(
        "no", F.col("no").cast("long") + 1
    )


_REVIEW_TOP_SQL = f"""{C.queries_sql(_QUERIES)}, {REVIEWS_SQL}, {PRODUCTS_SQL}, {C.postings_sql('v_reviews', 'review_id', [('title', True), ('text', True)])},
    {C.query_terms_sql([('title', True), ('text', True)])}, {C.bm25_sql()},
    scored AS (SELECT query_id, doc_id, round(max(score * CASE field WHEN 'title' THEN 2 ELSE 1 END), 6) AS score FROM field_scores GROUP BY 1, 2),
    top AS (SELECT s.query_id, s.doc_id, s.score, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, r.helpful_vote DESC, s.doc_id) AS rank
            FROM scored s JOIN v_reviews r ON r.review_id = s.doc_id JOIN queries q ON q.query_id = s.query_id
            WHERE r.rating <= 2 QUALIFY rank <= 10),
    marks AS (SELECT query_id, list_distinct(list(term)) AS terms FROM qterms GROUP BY 1),
    hits AS (SELECT t.query_id, t.rank, t.score, r.*, p.title AS product_title, p.brand, p.category, m.terms
             FROM top t JOIN v_reviews r ON r.review_id = t.doc_id JOIN marks m ON m.query_id = t.query_id
             LEFT JOIN v_products p ON p.product_id = r.product_id)"""


def _review_result(spark, folder):
    """Review evidence in the lucene dialect with a plain analyser and no misspellings."""
    from shelfsift.plans import search as S

    reviews, queries = views.reviews(spark, folder), C.query_table(spark, _QUERIES)
    matches, marks, order = S.review_matches(reviews, queries, "lucene", PRODUCT, fuzziness=False)
    fitting = S.fitting_reviews(matches, reviews, queries, "helpful_vote")
    page = materialized(limits.top_k(fitting, 10, order).select("query_id", "doc_id", "score", "rank"))
    rows = highlight.with_source(page, highlight.rows_of(reviews, "review_id", page), "review_id", marks, S.few_hits(queries, 10))
    parts = {
        "title": highlight.fragments(F.col("title"), F.col("terms"), 120, 1),
        "text": highlight.fragments(F.col("text"), F.col("terms"), 180, 2),
    }
    rows = rows.withColumn("highlights", highlight.highlight_map(parts)).drop("terms")
    attributes = views.products(spark, folder).select("product_id", F.col("title").alias("product_title"), "brand", "category")
    return rows.join(attributes, "product_id", "left")


_FIRST_PIECES = f"""keyed AS (SELECT query_id, review_id || ':title' AS doc_id, title AS text, terms FROM hits),
    {_pieces_sql(120, 1, 'keyed')},
    titles AS (SELECT query_id, split_part(doc_id, ':', 1) AS review_id, rtrim({mark_sql('piece', 'em')}) AS t FROM best),
    keyed2 AS (SELECT query_id, review_id AS doc_id, text, terms FROM hits),
    {_pieces_sql(180, 2, 'keyed2').replace('cut AS', 'cut2 AS').replace('FROM cut', 'FROM cut2').replace('numbered AS', 'numbered2 AS').replace('FROM numbered', 'FROM numbered2').replace('counted AS', 'counted2 AS').replace('FROM counted', 'FROM counted2').replace('best AS', 'best2 AS')},
    bodies AS (SELECT query_id, doc_id AS review_id, rtrim({mark_sql('piece', 'em')}) AS b FROM best2 WHERE no = 1)"""


@register("h05_evidence_snippets", f"""
    WITH {_REVIEW_TOP_SQL}, {_FIRST_PIECES}
    SELECT h.query_id, h.rank, h.review_id, h.product_id, h.product_title, h.rating, h.helpful_vote, coalesce(b.b, t.t, h.text) AS snippet
    FROM hits h LEFT JOIN bodies b ON b.query_id = h.query_id AND b.review_id = h.review_id
    LEFT JOIN titles t ON t.query_id = h.query_id AND t.review_id = h.review_id""")
def evidence_snippets(spark, folder):
    """One evidence line per hit: text highlight, title highlight, else the text."""
    hits = highlight.add_review_aliases(_review_result(spark, folder))
    return highlight.snippets(hits).withColumn("rank", F.col("rank").cast("long"))


@register("h06_drop_empty_highlights", f"""
    WITH {PRODUCTS_SQL} SELECT product_id, 'title' AS field, title AS fragment FROM v_products WHERE rating > 2
    UNION ALL SELECT product_id, 'features', features FROM v_products WHERE review_count % 3 = 0""")
def drop_empty_highlights(spark, folder):
    """Null and empty fragments leave no map entry."""
    parts = {
        "title": F.array(F.when(F.col("rating") > 2, F.col("title"))),
        "features": F.array(F.when(F.col("review_count") % 3 == 0, F.col("features")).otherwise("")),
        "description": F.array().cast("array<string>"),
    }
    rows = views.products(spark, folder).select("product_id", F.explode(highlight.highlight_map(parts)).alias("field", "pieces"))
    return rows.select("product_id", "field", F.col("pieces")[0].alias("fragment"))


@register("b11_review_aliases", f"""
    WITH {REVIEWS_SQL} SELECT review_id, title AS review_title, text AS review_text, '<' || title || '>' AS title_mark,
           CASE WHEN ord % 2 = 0 THEN 'own' ELSE '<' || lang || '>' END AS text_mark FROM v_reviews""")
def review_aliases(spark, folder):
    """Aliases are added where they are missing and never replace what is there."""
    reviews = views.reviews(spark, folder)
    own = F.create_map(F.lit("review_text"), F.array(F.lit("own")))
    base = F.create_map(
        F.lit("title"), F.array(F.concat(F.lit("<"), "title", F.lit(">"))),
        F.lit("text"), F.array(F.concat(F.lit("<"), "lang", F.lit(">"))),
    )
    marked = reviews.withColumn("highlights", F.when(F.col("ord") % 2 == 0, F.map_concat(base, own)).otherwise(base))
    rows = highlight.add_review_aliases(marked)
    return rows.select(
        "review_id", "review_title", "review_text",
        F.col("highlights")["review_title"][0].alias("title_mark"), F.col("highlights")["review_text"][0].alias("text_mark"),
    )


@register("b13_first_filled_text", f"""
    WITH {_REVIEW_TOP_SQL}, {_FIRST_PIECES}
    SELECT h.query_id, h.review_id, replace(replace(replace(coalesce(t.t, b.b, nullif(h.title, ''), h.text), '&amp;', '&'), '<em>', '<mark>'), '</em>', '</mark>') AS headline
    FROM hits h LEFT JOIN bodies b ON b.query_id = h.query_id AND b.review_id = h.review_id
    LEFT JOIN titles t ON t.query_id = h.query_id AND t.review_id = h.review_id""")
def first_filled_text(spark, folder):
    """Title highlight, then text highlight, then the plain fields; marks cleaned."""
    hits = _review_result(spark, folder)
    headline = display.first_text(F.col("highlights"), ["title", "text"], [F.col("title"), F.col("text")])
    return hits.select("query_id", "review_id", headline.alias("headline"))


@register("b15_hit_assembly", f"""
    WITH {_REVIEW_TOP_SQL}, {_FIRST_PIECES}
    SELECT h.query_id, h.rank, h.score, h.review_id, h.product_id, h.rating, h.helpful_vote, h.verified_purchase, h.product_title, h.brand,
           (t.t IS NOT NULL) AS has_title_mark, (b.b IS NOT NULL) AS has_text_mark
    FROM hits h LEFT JOIN bodies b ON b.query_id = h.query_id AND b.review_id = h.review_id
    LEFT JOIN titles t ON t.query_id = h.query_id AND t.review_id = h.review_id""")
def hit_assembly(spark, folder):
    """Source columns, score and highlight map of the hits; helper columns are gone."""
    hits = _review_result(spark, folder)
    return hits.select(
        "query_id", F.col("rank").cast("long").alias("rank"), "score", "review_id", "product_id", "rating", "helpful_vote",
        "verified_purchase", "product_title", "brand",
        F.map_contains_key("highlights", F.lit("title")).alias("has_title_mark"),
        F.map_contains_key("highlights", F.lit("text")).alias("has_text_mark"),
    )


def _three_dialects(spark, folder):
    """The ten best products of each dialect for misspelt and plain queries."""
    from shelfsift.operators import rank

    queries = C.query_table(spark, C.PRODUCT_QUERIES)
    index = C.product_index(spark, folder)

    def run(dialect):
        if dialect == "lucene":
            terms = postings.query_terms(queries, index.fields)
            found = match.any_term_match(index, terms, C.PRODUCT_BOOSTS)
            order = [F.desc("score"), F.asc("doc_id")]
        elif dialect == "ladder":
            found, order = ladder.ladder_matches(index, ladder.ladder_terms(index, queries)), ladder.ladder_order()
        else:
            units = match.query_units(queries, PLAIN_WORDS)
            found = rank.cover_rank(M.weighted_positions(spark, folder), match.ranked_slots(units))
            order = [F.desc("score"), F.asc("doc_id")]
        page = limits.top_k(found, 10, order)
        return page.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"))

    return side_by_side(run)


_WEIGHTED_U1 = M._CHAINED_SQL.replace(C.queries_sql(M._ECONOMY) + ",", "").replace(PRODUCTS_SQL + ",", "")
_THREE_SQL = f"""{M._PRODUCT_SQL}, {C.bm25_sql()}, {M._BOOSTED},
    lucene AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10),
    {M.ladder_sql('qterms', 3)},
    ladder AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY {M.LADDER_ORDER_SQL}) AS rank
               FROM ladder_rows QUALIFY rank <= 10),
    {_WEIGHTED_U1},
    wslots AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY term) AS slot FROM hits),
    wlast AS (SELECT query_id, doc_id, pos, n_terms,
               max(CASE WHEN slot = 1 THEN {{'p': pos, 'w': weight}} END) OVER w AS a, max(CASE WHEN slot = 2 THEN {{'p': pos, 'w': weight}} END) OVER w AS b,
               max(CASE WHEN slot = 3 THEN {{'p': pos, 'w': weight}} END) OVER w AS c
             FROM wslots WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY pos)),
    complete AS (SELECT query_id, doc_id, least(a.p, b.p, c.p) AS s, pos AS e,
                   n_terms / (coalesce(1 / a.w, 0) + coalesce(1 / b.w, 0) + coalesce(1 / c.w, 0)) AS hm
                 FROM wlast WHERE (a.p IS NOT NULL)::INT + (b.p IS NOT NULL)::INT + (c.p IS NOT NULL)::INT = n_terms),
    wspans AS (SELECT query_id, doc_id, s, min(e) AS e, arg_min(hm, e) AS hm FROM complete GROUP BY 1, 2, 3),
    wscored AS (SELECT query_id, doc_id, round(sum(hm / (e - s + 1)), 6) AS score FROM wspans GROUP BY 1, 2),
    weighted AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM wscored QUALIFY rank <= 10),
    everything AS (SELECT 'lucene' AS engine, * FROM lucene UNION ALL SELECT 'ladder', * FROM ladder UNION ALL SELECT 'weighted', * FROM weighted)"""


@register("u01_dialects_side_by_side", f"WITH {_THREE_SQL} SELECT engine, query_id, doc_id, rank FROM everything")
def dialects_side_by_side(spark, folder):
    return _three_dialects(spark, folder)


@register("u01_dialect_overlap", f"""
    WITH {_THREE_SQL} SELECT query_id, doc_id, string_agg(engine, '+' ORDER BY engine) AS engines FROM everything GROUP BY 1, 2""")
def dialect_overlap(spark, folder):
    """Which dialects put a product on their first page."""
    rows = overlap(_three_dialects(spark, folder))
    return rows.withColumn("engines", F.array_join("engines", "+"))


@register("u02_ordered_distinct", """
    SELECT p_brand, p_name, min(p_partkey) AS first_seen FROM part GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY first_seen) <= 5""")
def ordered_distinct(spark, folder):
    """Distinct names in order of first appearance."""
    rows = table(spark, folder, "part").groupBy("p_brand", "p_name").agg(F.min("p_partkey").alias("first_seen"))
    return limits.first_per_key(rows, ["p_brand"], [F.asc("first_seen")], 5)
