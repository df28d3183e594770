"""Product and review search in three dialects.

``lucene``: any word, boosted fields, best field wins, typos by edit distance.
``ladder``: typo-tolerant, ranked criterion by criterion.
``weighted``: all words by their English stems (with or, not and phrases), class weights.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.functions import filters
from shelfsift.functions.filters import ProductFilter
from shelfsift.functions.stem import stem
from shelfsift.functions.text import ENGLISH_REVIEW, ENGLISH_TEXT, PLAIN_WORDS, PRODUCT, Analyzer, word_trigrams
from shelfsift.operators import enrich, facets, fuzzy, highlight, ladder, limits, match, rank, trigram
from shelfsift.operators.postings import (
    IndexField, TextIndex, folded_to_stems, query_terms, stemmed_vocabulary, term_positions, vocabulary,
)
from shelfsift.operators.sizes import MAX_BROADCAST_ROWS, hinted, is_small, materialized
from shelfsift.schemas import PRODUCT_SEARCHABLE, REVIEW_SEARCHABLE, REVIEW_SORTABLE

DIALECTS = ["lucene", "ladder", "weighted"]

# Field boosts of the basic search, of the product scenario, and of reviews.
BASIC_BOOSTS = {"title": 4, "features": 2, "brand": 2, "category": 2, "description": 1, "review_text": 1}
SCENARIO_BOOSTS = {"title": 5, "brand": 3, "category": 2, "features": 3, "description": 2, "review_text": 1}
REVIEW_BOOSTS = {"title": 2, "text": 1}


@dataclass(frozen=True)
class SearchResult:
    """Hits with rank, score and highlights; facets in long form; totals per query."""

    hits: DataFrame
    totals: DataFrame
    facets: DataFrame | None = None
    snippets: DataFrame | None = None


def _available(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n in df.columns]


@dataclass(frozen=True)
class KeywordAnalyzer(Analyzer):
    """The whole value as one term, as it is."""

    def tokens(self, text: Column) -> Column:
        return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array(text))

    def count(self, text: Column) -> Column:
        return F.when(text.isNull(), 0).otherwise(1)


KEYWORD = KeywordAnalyzer(folded=False)


def product_fields(products: DataFrame, exact_attributes: bool = False) -> list[IndexField]:
    """Searchable product fields; brand and category either word by word or as whole values."""
    attribute = KEYWORD if exact_attributes else PLAIN_WORDS
    return [
        IndexField(n, analyzer=attribute if n in ("brand", "category") else PRODUCT)
        for n in _available(products, PRODUCT_SEARCHABLE)
    ]


def product_index(products: DataFrame, exact_attributes: bool = False) -> TextIndex:
    return TextIndex.of(products, product_fields(products, exact_attributes), "product_id")


def review_fields(analyzer: Analyzer = ENGLISH_REVIEW) -> list[IndexField]:
    return [IndexField(n, analyzer=analyzer) for n in REVIEW_SEARCHABLE]


def review_index(reviews: DataFrame, analyzer: Analyzer = ENGLISH_REVIEW) -> TextIndex:
    return TextIndex.of(reviews, review_fields(analyzer), "review_id")


@dataclass(frozen=True)
class SearchIndex:
    """Postings that are already there; what is missing is derived from the tables on the fly."""

    products: TextIndex | None = None
    reviews: TextIndex | None = None
    product_positions: DataFrame | None = None
    review_positions: DataFrame | None = None
    # (term, stem) of the words in the two tables of positions.
    product_words: DataFrame | None = None
    review_words: DataFrame | None = None
    # Words, pairs and triples of the titles, for completion.
    titles: TextIndex | None = None
    # Products with brand and category as whole values; reviews with all their words.
    exact_products: TextIndex | None = None
    plain_reviews: TextIndex | None = None


NO_INDEX = SearchIndex()


def class_positions(df: DataFrame, classes: dict[str, str], id_column: str, analyzer: Analyzer) -> DataFrame:
    """Chained positions with class weights, the table the weighted dialect searches."""
    present = {name: c for name, c in classes.items() if name in df.columns}
    return term_positions(df, match.weighted_fields(present, analyzer), id_column, chained=True)


def filtered(hits: DataFrame, source: DataFrame, id_column: str, predicate: Column) -> DataFrame:
    """Hits whose source row passes; the filter reaches the scan of the source."""
    passing = source.filter(predicate).select(F.col(id_column).alias("doc_id"))
    return hits.join(passing, "doc_id", "left_semi")


# Lucene dialect ---------------------------------------------------------------


def lucene_matches(index: TextIndex, queries: DataFrame, boosts: dict[str, float], fuzziness: bool = True,
                   prefix_length: int = 0, stemming: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scores, words to mark) of documents with any of the words or near spellings of them."""
    terms = query_terms(queries, index.fields, stem if stemming else None)
    known = vocabulary(index)
    if stemming:
        # Stems of the distinct words only; corpus rows are looked up by the words that share a stem.
        words = materialized(stemmed_vocabulary(index))
        known = words.select("field", F.col("stem").alias("term")).distinct()
    if fuzziness:
        terms = fuzzy.expand_terms(terms, known, prefix_length=prefix_length, keys=None if stemming else index.keys)
    if not stemming:
        return match.any_term_match(index, terms, boosts), highlight.spelled_terms(terms)
    wanted = terms.select("field", F.col("term").alias("stem")).distinct()
    sharing = materialized(words.join(hinted(wanted, is_small(wanted)), ["field", "stem"]))
    marks = terms.select("query_id", "field", F.col("term").alias("stem")).join(sharing, ["field", "stem"])
    return match.any_term_match(folded_to_stems(index, sharing), terms, boosts), highlight.spelled_terms(marks)


# Weighted dialect -------------------------------------------------------------


@dataclass(frozen=True)
class WeightedQuery:
    """Queries split into units, the postings they can meet, and the words to mark."""

    units: DataFrame
    positions: DataFrame
    marks: DataFrame


def weighted_query(positions: DataFrame, queries: DataFrame, analyzer: Analyzer, words: DataFrame | None = None) -> WeightedQuery:
    """With a stemming analyzer the query and the postings meet by stem, and every word of that stem is marked."""
    units = match.query_units(queries, analyzer)
    if not analyzer.stems:
        return WeightedQuery(units, positions, match.highlight_terms(units))
    units = materialized(units)
    by_stem, sharing = match.stemmed_postings(positions, units, words)
    return WeightedQuery(units, by_stem, match.highlight_terms(units, sharing))


def _ids(rows: DataFrame, id_column: str) -> DataFrame:
    return rows.select(F.col(id_column).alias("doc_id"))


def weighted_basic_hits(products: DataFrame, positions: DataFrame, queries: DataFrame, analyzer: Analyzer,
                        wanted: ProductFilter, k: int, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(page, words to mark): text match, or trigram match on title or description; score = rank + title similarity."""
    kept = products.filter(wanted.predicate())
    asked = weighted_query(positions, queries, analyzer, words)
    keys = ["query_id", "doc_id"]
    ranked = match.matching_documents(asked.positions, asked.units, _ids(kept, "product_id")).join(
        rank.frequency_rank(asked.positions, match.ranked_slots(asked.units)), keys, "left"
    )
    found = [ranked.select(*keys, "score")]
    for name in ("title", "description"):
        alike = trigram.similar(kept, "product_id", name, queries)
        found.append(alike.select(*keys, F.lit(None).cast("double").alias("score")))
    pairs = found[0].unionByName(found[1]).unionByName(found[2]).groupBy(*keys).agg(F.max("score").alias("score"))
    # The similarity of the titles counts for every pair found, however low it is.
    titles = kept.select(F.col("product_id").alias("doc_id"), word_trigrams(F.col("title")).alias("grams"))
    texts = queries.select("query_id", word_trigrams(F.col("q")).alias("q_grams"))
    matches = pairs.join(titles, "doc_id").join(hinted(texts, is_small(texts)), "query_id")
    alike = trigram.similarity_of(F.col("grams"), F.col("q_grams"))
    scored = matches.select(
        *keys, F.round(F.coalesce("score", F.lit(0.0)) + alike, match.SCORE_DIGITS).alias("score")
    )
    attributes = kept.select(F.col("product_id").alias("doc_id"), "rating", "review_count")
    order = [F.desc("score"), F.desc("rating"), F.desc("review_count"), F.asc("doc_id")]
    return limits.top_k(scored.join(attributes, "doc_id"), k, order), asked.marks


def weighted_matches(positions: DataFrame, queries: DataFrame, analyzer: Analyzer, documents: DataFrame,
                     words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores by cover density, words to mark) of the documents that hold the query.

    ``documents`` (doc_id) are all there are, for queries that only exclude.
    """
    asked = weighted_query(positions, queries, analyzer, words)
    matched = match.matching_documents(asked.positions, asked.units, documents)
    covered = rank.cover_rank(asked.positions, match.ranked_slots(asked.units))
    scores = matched.join(covered, ["query_id", "doc_id"], "left").withColumn(
        "score", F.coalesce("score", F.lit(0.0))
    )
    return scores, asked.marks


# Flows -------------------------------------------------------------------------


def _product_facets(rows: DataFrame, dialect: str, by: list[str]) -> DataFrame:
    """Facets of product rows in long form (facet, value, n)."""
    columns = [*by, "facet", "value", "n"]
    if dialect == "ladder":
        parts = [facets.value_counts(rows, c, by).withColumn("facet", F.lit(c)) for c in ("brand", "category")]
    else:
        parts = [facets.terms_facet(rows, c, 10, by).withColumn("facet", F.lit(c)) for c in ("brand", "category")]
    if dialect == "lucene":
        parts.append(facets.range_buckets(rows, "price", by=by).withColumn("facet", F.lit("price")))
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out


def few_hits(queries: DataFrame, k: int) -> bool:
    """Whether all pages together, ``k`` rows per query, stay small."""
    return is_small(queries, MAX_BROADCAST_ROWS // (10 * k))


def _marked_products(page: DataFrame, products: DataFrame, marks: DataFrame, fields: list[str],
                     dialect: str, small: bool) -> DataFrame:
    rows = highlight.with_source(page, products, "product_id", marks, small)
    terms = F.col("terms")
    parts = {}
    for name in _available(products, fields):
        text = F.coalesce(name, F.lit(""))
        if dialect == "lucene":
            parts[name] = highlight.fragments(text, terms, 100, 5)
        elif dialect == "ladder":
            parts[name] = F.array(highlight.mark_all(text, terms, "em"))
        elif name == "title":
            parts[name] = F.array(highlight.mark_all(text, terms, analyzer=ENGLISH_TEXT))
        else:
            parts[name] = F.array(highlight.best_fragment(text, terms, 24, analyzer=ENGLISH_TEXT))
    return rows.withColumn("highlights", highlight.highlight_map(parts)).drop("terms")


def basic_product_search(products: DataFrame, queries: DataFrame, dialect: str,
                         wanted: ProductFilter = ProductFilter(), k: int = 10,
                         stored: SearchIndex = NO_INDEX) -> SearchResult:
    """Filters, text match, hits, highlights and facets."""
    predicate = wanted.predicate()
    kept = products.filter(predicate)
    by_score = [F.desc("score"), F.asc("doc_id")]
    fields = ["title", "description", "review_text"]
    if dialect == "weighted":
        positions = stored.product_positions
        if positions is None:
            positions = class_positions(products, match.PRODUCT_CLASSES, "product_id", ENGLISH_TEXT)
        page, marks = weighted_basic_hits(products, positions, queries, ENGLISH_TEXT, wanted, k, stored.product_words)
        hits = _marked_products(page.select("query_id", "doc_id", "score", "rank"), products, marks, fields[:2], dialect, few_hits(queries, k))
        # The total is the number of rows returned, and facets look at the filters only.
        return SearchResult(hits, limits.match_totals(page), _product_facets(kept, dialect, []))
    if dialect == "lucene":
        index = stored.exact_products or product_index(products, exact_attributes=True)
        matches, marks = lucene_matches(index, queries, BASIC_BOOSTS)
        order = by_score
    else:
        index = stored.products or product_index(products)
        terms = ladder.ladder_terms(index, queries)
        matches, marks, order = ladder.ladder_matches(index, terms), highlight.spelled_terms(terms), ladder.ladder_order()
    matches = filtered(matches, products, "product_id", predicate)
    page = limits.top_k(matches, k, order).select("query_id", "doc_id", "score", "rank")
    hits = _marked_products(page, products, marks, fields, dialect, few_hits(queries, k))
    facet_rows = matches.select("query_id", F.col("doc_id").alias("product_id")).join(
        kept.select("product_id", "brand", "category", "price"), "product_id"
    )
    return SearchResult(hits, limits.match_totals(matches), _product_facets(facet_rows, dialect, ["query_id"]))


def product_scenario(products: DataFrame, queries: DataFrame, dialect: str, k: int = 10,
                     stored: SearchIndex = NO_INDEX) -> SearchResult:
    """Product search as the comparison runs it: boosts and typos, ladder, or cover density."""
    index = stored.products or product_index(products)
    fields = ["title", "features", "description", "review_text"]
    if dialect == "lucene":
        matches, marks = lucene_matches(index, queries, SCENARIO_BOOSTS, prefix_length=1)
        order = [F.desc("score"), F.asc("doc_id")]
    elif dialect == "ladder":
        terms = ladder.ladder_terms(index, queries)
        matches, marks, order = ladder.ladder_matches(index, terms), highlight.spelled_terms(terms), ladder.ladder_order()
    else:
        positions = stored.product_positions
        if positions is None:
            positions = class_positions(products, match.PRODUCT_CLASSES, "product_id", ENGLISH_TEXT)
        every = _ids(products, "product_id")
        matches, marks = weighted_matches(positions, queries, ENGLISH_TEXT, every, stored.product_words)
        rating = "average_rating" if "average_rating" in products.columns else "rating"
        count = "rating_number" if "rating_number" in products.columns else "review_count"
        ranks = products.select(F.col("product_id").alias("doc_id"), F.col(rating).alias("_r"), F.col(count).alias("_c"))
        matches = matches.join(ranks, "doc_id")
        order = [F.desc("score"), F.desc("_r"), F.desc("_c"), F.asc("doc_id")]
        fields = ["title", "description"]
    page = limits.top_k(matches, k, order).select("query_id", "doc_id", "score", "rank")
    hits = _marked_products(page, products, marks, fields, dialect, few_hits(queries, k))
    return SearchResult(hits, limits.match_totals(matches))


def fitting_reviews(matches: DataFrame, reviews: DataFrame, queries: DataFrame, *columns: str) -> DataFrame:
    """Matches whose rating fits the mood of their query, with the named review columns."""
    rated = reviews.select(F.col("review_id").alias("doc_id"), "rating", *columns)
    asked = queries.select("query_id", "q")
    joined = matches.join(rated, "doc_id").join(hinted(asked, is_small(asked)), "query_id")
    return joined.filter(filters.rating_fits(F.col("q"), F.col("rating"))).drop("q")


def review_matches(reviews: DataFrame, queries: DataFrame, dialect: str, analyzer: Analyzer = ENGLISH_REVIEW,
                   fuzziness: bool = True, stemming: bool = False,
                   stored: SearchIndex = NO_INDEX) -> tuple[DataFrame, DataFrame, list[Column]]:
    """(matches, words to mark, hit order) of reviews in one dialect, before the rating filter.

    ``analyzer`` and ``stemming`` are the first dialect's; the weighted one always compares English stems.
    """
    by_votes = [F.desc("score"), F.desc("helpful_vote"), F.asc("doc_id")]
    if dialect == "lucene":
        index = stored.reviews or review_index(reviews, analyzer)
        matches, marks = lucene_matches(index, queries, REVIEW_BOOSTS, fuzziness, stemming=stemming)
        return matches, marks, by_votes
    if dialect == "ladder":
        index = stored.plain_reviews or review_index(reviews, PRODUCT)
        terms = ladder.ladder_terms(index, queries)
        order = ladder.ladder_order(limits.sort_column("helpful_vote", REVIEW_SORTABLE))
        return ladder.ladder_matches(index, terms), highlight.spelled_terms(terms), order
    positions = stored.review_positions
    if positions is None:
        positions = class_positions(reviews, match.REVIEW_CLASSES, "review_id", ENGLISH_TEXT)
    every = _ids(reviews, "review_id")
    matches, marks = weighted_matches(positions, queries, ENGLISH_TEXT, every, stored.review_words)
    return matches, marks, by_votes


def review_scenario(reviews: DataFrame, products: DataFrame, queries: DataFrame, dialect: str, k: int = 10,
                    analyzer: Analyzer = ENGLISH_REVIEW, stemming: bool = False,
                    stored: SearchIndex = NO_INDEX) -> SearchResult:
    """Review evidence: matching reviews of the fitting mood, most helpful first among equals."""
    matches, marks, order = review_matches(reviews, queries, dialect, analyzer, stemming=stemming, stored=stored)
    if dialect == "weighted":
        # This dialect keeps reviews normalised: only reviews of known products count.
        known = enrich.of_known_products(reviews, products)
        fitting = fitting_reviews(matches, known, queries, "helpful_vote")
    else:
        fitting = fitting_reviews(matches, reviews, queries, "helpful_vote")
    # The page and the totals both read the matches.
    fitting = materialized(fitting)
    page = materialized(limits.top_k(fitting, k, order).select("query_id", "doc_id", "score", "rank"))
    shown = highlight.rows_of(reviews, "review_id", page)
    rows = highlight.with_source(page, shown, "review_id", marks, few_hits(queries, k))
    terms, title, text = F.col("terms"), F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    if dialect == "lucene":
        parts = {
            "title": highlight.fragments(title, terms, 120, 1, analyzer=analyzer),
            "text": highlight.fragments(text, terms, 180, 2, analyzer=analyzer),
        }
    elif dialect == "ladder":
        parts = {n: F.array(highlight.mark_all(c, terms, "em")) for n, c in (("title", title), ("text", text))}
    else:
        parts = {
            "title": F.array(highlight.mark_all(title, terms, analyzer=ENGLISH_TEXT)),
            "text": F.array(highlight.best_fragment(text, terms, 32, analyzer=ENGLISH_TEXT)),
        }
    rows = rows.withColumn("highlights", highlight.highlight_map(parts)).drop("terms", "product_title", "brand", "category")
    attributes = products.select("product_id", F.col("title").alias("product_title"), "brand", "category")
    hits = highlight.add_review_aliases(rows.join(attributes, "product_id", "left"))
    return SearchResult(hits, limits.match_totals(fitting), snippets=highlight.snippets(hits))


def side_by_side(run: Callable[[str], DataFrame], dialect: str = "all") -> DataFrame:
    """The hits of one or all dialects in one table, told apart by ``engine``."""
    chosen = DIALECTS if dialect == "all" else [dialect]
    parts = [run(d).withColumn("engine", F.lit(d)) for d in chosen]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def overlap(results: DataFrame) -> DataFrame:
    """Which dialects found each document."""
    return results.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_set("engine")).alias("engines"))
