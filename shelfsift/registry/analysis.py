"""Text analysis tables (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsift.functions.distance import auto_edits, edit_distance
from shelfsift.functions.stem import english_stem
from shelfsift.functions.text import ENGLISH_REVIEW, ENGLISH_TEXT, PLAIN_WORDS, PRODUCT, shingles, word_trigrams
from shelfsift.operators import match, postings
from shelfsift.operators.postings import IndexField
from shelfsift.registry import register
from shelfsift.registry import corpora as C
from shelfsift.registry.stems import later_stems_sql, stems_sql
from shelfsift.sources import views
from shelfsift.sources.views import ENRICHED_SQL, PRODUCTS_SQL, REVIEWS_SQL, table


@register("e01_product_analyzer", f"""
    WITH {C.DOCUMENT_POSTINGS_SQL} SELECT doc_id, term, pos FROM posts""")
def product_analyzer(spark, folder):
    """Every word of every document with its place, accents folded."""
    return C.document_index(spark, folder).positions.select("doc_id", "term", "pos")


@register("e02_plain_analyzer", f"""
    WITH {PRODUCTS_SQL} SELECT product_id, array_to_string({C.tokens_sql('brand', False)}, '|') AS brand_words,
           array_to_string({C.tokens_sql('category', False)}, '|') AS category_words FROM v_products""")
def plain_analyzer(spark, folder):
    return views.products(spark, folder).select(
        "product_id", F.array_join(PLAIN_WORDS.tokens(F.col("brand")), "|").alias("brand_words"),
        F.array_join(PLAIN_WORDS.tokens(F.col("category")), "|").alias("category_words"),
    )


@register("e03_review_analyzer", f"""
    WITH words AS (
      SELECT doc_id, regexp_extract_all({C.fold_sql("lower(replace(text, ' the ', ' the customer''s '))")},
             '[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)*') AS toks FROM documents),
    rows AS (SELECT doc_id, regexp_replace(unnest(toks), '[''’]s$', '') AS term, generate_subscripts(toks, 1) AS pos FROM words)
    SELECT doc_id, term, pos FROM rows WHERE term NOT IN ({C.STOP_SQL})""")
def review_analyzer(spark, folder):
    """Possessives cut, stop words gone but counted in the positions; not stemmed."""
    docs = table(spark, folder, "documents").withColumn(
        "text", F.replace("text", F.lit(" the "), F.lit(" the customer's "))
    )
    rows = postings.term_positions(docs, [IndexField("text", analyzer=ENGLISH_REVIEW)], "doc_id")
    return rows.select("doc_id", "term", "pos")


@register("e03_review_analyzer_stemmed", f"""
    WITH words AS (SELECT doc_id, regexp_extract_all({C.fold_sql("lower(text)")}, '[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)*') AS toks FROM documents),
    rows AS (SELECT doc_id, regexp_replace(unnest(toks), '[''’]s$', '') AS term, generate_subscripts(toks, 1) AS pos FROM words),
    kept AS (SELECT * FROM rows WHERE term NOT IN ({C.STOP_SQL})), {stems_sql('kept', 'stems')}
    SELECT k.doc_id, s.stem AS term, CAST(k.pos AS INT) AS pos FROM kept k JOIN stems s ON s.term = k.term""")
def review_analyzer_stemmed(spark, folder):
    """The same with stems, looked up once per distinct word."""
    index = postings.TextIndex.of(table(spark, folder, "documents"), [IndexField("text", analyzer=ENGLISH_REVIEW)], "doc_id")
    return index.stemmed(postings.stem_table(index.positions)).positions.select("doc_id", "term", "pos")


@register("e04_weighted_vectors", f"""
    WITH {PRODUCTS_SQL}, t AS (
      SELECT product_id, {C.tokens_sql('title')} AS a, {C.tokens_sql('brand')} AS b, {C.tokens_sql('category')} AS c,
             {C.tokens_sql('features')} AS d, {C.tokens_sql('description')} AS e FROM v_products),
    chained AS (
      SELECT product_id, unnest(a) AS term, generate_subscripts(a, 1) AS pos, 1.0 AS weight FROM t
      UNION ALL SELECT product_id, unnest(b), len(a) + generate_subscripts(b, 1), 0.4 FROM t
      UNION ALL SELECT product_id, unnest(c), len(a) + len(b) + generate_subscripts(c, 1), 0.4 FROM t
      UNION ALL SELECT product_id, unnest(d), len(a) + len(b) + len(c) + generate_subscripts(d, 1), 0.4 FROM t
      UNION ALL SELECT product_id, unnest(e), len(a) + len(b) + len(c) + len(d) + generate_subscripts(e, 1), 0.2 FROM t)
    SELECT product_id AS doc_id, term, CAST(pos AS INT) AS pos, CAST(weight AS DOUBLE) AS weight FROM chained""")
def weighted_vectors(spark, folder):
    classes = {k: v for k, v in match.PRODUCT_CLASSES.items() if k != "review_text"}
    rows = postings.term_positions(
        views.products(spark, folder), match.weighted_fields(classes, PRODUCT), "product_id", chained=True
    )
    return rows.select("doc_id", "term", "pos", "weight")


@register("e05_stems", f"""
    WITH words AS (SELECT DISTINCT unnest({C.tokens_sql('text')}) AS term FROM documents), {stems_sql('words', 'stems')}
    SELECT term, stem FROM stems""")
def stems(spark, folder):
    """Stem of every distinct word of the documents."""
    return postings.stem_table(C.document_index(spark, folder).positions)


@register("e05_later_stems", f"""
    WITH words AS (SELECT DISTINCT unnest({C.tokens_sql('text')}) AS term FROM documents), {later_stems_sql('words', 'stems')}
    SELECT term, stem FROM stems""")
def later_stems(spark, folder):
    """The same by the later algorithm, which the weighted dialect uses."""
    return postings.stem_table(C.document_index(spark, folder).positions, english_stem)


_CLASSES = match.PRODUCT_CLASSES


@register("e04_english_vectors", f"""
    WITH {PRODUCTS_SQL}, {REVIEWS_SQL}, {ENRICHED_SQL}, {C.english_sql('v_enriched', 'product_id', _CLASSES, [(1, 0, 'red', False)])}
    SELECT doc_id, term, CAST(pos AS INT) AS pos, weight FROM chained""")
def english_vectors(spark, folder):
    """Six fields in four classes: stop words gone but counted in the positions, stems in place of the words."""
    rows = postings.term_positions(
        views.enriched_products(spark, folder), match.weighted_fields(_CLASSES, ENGLISH_TEXT), "product_id", chained=True
    )
    stems = postings.stem_table(rows, english_stem)
    return rows.join(stems, "term").select("doc_id", F.col("stem").alias("term"), "pos", "weight")


@register("e06_shingles", f"""
    WITH {PRODUCTS_SQL}, t AS (SELECT product_id, {C.tokens_sql('description')} AS toks FROM v_products)
    SELECT product_id, n, array_to_string(toks[i:i + n - 1], ' ') AS shingle
    FROM (SELECT product_id, toks, n, unnest(generate_series(1, len(toks) - n + 1)) AS i
          FROM t, (VALUES (2), (3)) v(n) WHERE len(toks) >= n)""")
def product_shingles(spark, folder):
    tokens = views.products(spark, folder).select("product_id", PRODUCT.tokens(F.col("description")).alias("tokens"))
    sizes = F.array(*[
        F.struct(F.lit(n).alias("n"), shingles(F.col("tokens"), n).alias("runs")) for n in (2, 3)
    ])
    return tokens.select("product_id", F.inline(sizes)).select("product_id", "n", F.explode("runs").alias("shingle"))


_TRIGRAM_SQL = """SELECT DISTINCT {id}, substring(w, i, 3) AS gram FROM (
      SELECT {id}, w, unnest(generate_series(1, length(w) - 2)) AS i FROM (
        SELECT {id}, '  ' || unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) || ' ' AS w FROM {source}))"""


@register("e07_trigrams", _TRIGRAM_SQL.format(id="p_partkey", text="p_name", source="part"))
def trigrams(spark, folder):
    return table(spark, folder, "part").select("p_partkey", F.explode(word_trigrams(F.col("p_name"))).alias("gram"))


@register("e08_term_statistics", f"""
    WITH {C.DOCUMENT_POSTINGS_SQL} SELECT field, term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM posts GROUP BY 1, 2""")
def term_statistics(spark, folder):
    return postings.term_statistics(C.document_index(spark, folder).positions)


@register("e08_field_statistics", f"""
    WITH {C.PRODUCT_POSTINGS_SQL} SELECT field, n_docs, round(avg_dl, 9) AS avg_dl FROM posts_stats""")
def field_statistics(spark, folder):
    return C.product_index(spark, folder).statistics.withColumn("avg_dl", F.round("avg_dl", 9))


@register("e09_edit_distance", """
    WITH names AS (SELECT DISTINCT p_name FROM part), words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM names),
    odd AS (SELECT w, reverse(w) AS r, substring(w, 2) || substring(w, 1, 1) AS s, w || 'x' AS t,
                   substring(w, 2, 1) || substring(w, 1, 1) || substring(w, 3) AS u FROM words),
    pairs AS (SELECT w AS a, unnest([r, s, t, u]) AS b FROM odd UNION ALL SELECT n_name, replace(n_name, 'NATION', 'NAITON') FROM nation)
    SELECT a, b, CAST(least(damerau_levenshtein(a, b), 3) AS INT) AS distance,
           CASE WHEN length(a) <= 2 THEN 0 WHEN length(a) <= 5 THEN 1 ELSE 2 END AS allowed FROM pairs""")
def distances(spark, folder):
    """Words of the part names against reversed, rotated, lengthened and swapped forms."""
    words = table(spark, folder, "part").select(F.explode(F.split("p_name", " ")).alias("a")).distinct()
    a = F.col("a")
    rest = F.substring(a, 2, 1000)
    forms = F.array(
        F.reverse(a), F.concat(rest, F.substring(a, 1, 1)), F.concat(a, F.lit("x")),
        F.concat(F.substring(a, 2, 1), F.substring(a, 1, 1), F.substring(a, 3, 1000)),
    )
    nations = table(spark, folder, "nation").select(
        F.col("n_name").alias("a"), F.replace("n_name", F.lit("NATION"), F.lit("NAITON")).alias("b")
    )
    pairs = words.select("a", F.explode(forms).alias("b")).unionByName(nations)
    return pairs.select("a", "b", edit_distance(a, F.col("b")).alias("distance"), auto_edits(a).alias("allowed"))


@register("e10_exact_values", f"""
    WITH {PRODUCTS_SQL} SELECT product_id, title, brand FROM v_products WHERE title = 'red widget' OR brand = 'Brand#17'""")
def exact_values(spark, folder):
    """Whole-value matches on title and brand."""
    return views.products(spark, folder).filter(
        (F.col("title") == "red widget") | (F.col("brand") == "Brand#17")
    ).select("product_id", "title", "brand")
