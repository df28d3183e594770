"""Highlights and snippets. Everything here is meant for hits, after the top-k cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.functions.text import PRODUCT, WORD, Analyzer, fold
from shelfsift.operators.postings import PUSHED_TERMS
from shelfsift.operators.sizes import hinted

_PIECE = WORD + r"|[^\p{L}\p{N}]+"
_WORD_AND_GAP = WORD + r"[^\p{L}\p{N}]*"
# A lazy line of at most this many characters, broken at white space where there is any.
_CHUNK = r"(?s).{{1,{size}}}(?:\s|\z)|.{{1,{size}}}"

SNIPPET_KEYS = ["review_text", "text", "review_title", "title"]
SNIPPET_ROWS = 10


def _normal(piece: Column, analyzer: Analyzer) -> Column:
    lowered = F.lower(piece)
    return fold(lowered) if analyzer.folded else lowered


def mark_all(text: Column, terms: Column, tag: str = "mark", analyzer: Analyzer = PRODUCT) -> Column:
    """The whole text with every query word marked, original spelling kept."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    marked = F.transform(
        pieces,
        lambda p: F.when(
            F.array_contains(terms, _normal(p, analyzer)), F.concat(F.lit(f"<{tag}>"), p, F.lit(f"</{tag}>"))
        ).otherwise(p),
    )
    return F.array_join(marked, "")


def _let(value: Column, body) -> Column:
    """Evaluate a value once and use it in an expression, also inside its lambdas."""
    return F.transform(F.array(value), body)[0]


def best_fragment(text: Column, terms: Column, words: int, tag: str = "mark", analyzer: Analyzer = PRODUCT) -> Column:
    """The run of at most ``words`` words with most query words, the earliest of equals."""

    def start_of(flags: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(flags) - (words - 1), F.lit(1)))
        scored = F.transform(
            starts,
            lambda i: F.struct(F.size(F.array_compact(F.slice(flags, i, words))).alias("hits"), (-i).alias("at")),
        )
        return -F.array_max(scored)["at"]

    def run_of(units: Column) -> Column:
        # A query word is true, any other word null.
        flags = F.transform(
            units,
            lambda u: F.when(F.array_contains(terms, _normal(F.regexp_extract(u, WORD, 0), analyzer)), True),
        )
        return F.rtrim(F.array_join(F.slice(units, _let(flags, start_of), words), ""))

    run = _let(F.regexp_extract_all(text, F.lit(_WORD_AND_GAP), F.lit(0)), run_of)
    return F.when(text.rlike(WORD), mark_all(run, terms, tag, analyzer)).otherwise("")


def fragments(text: Column, terms: Column, size: int, count: int, tag: str = "em",
              analyzer: Analyzer = PRODUCT) -> Column:
    """Up to ``count`` non-overlapping pieces of about ``size`` characters that hold query words.

    Pieces with more query words come first, earlier ones among equals.
    """
    pieces = F.regexp_extract_all(text, F.lit(_CHUNK.format(size=size)), F.lit(0))
    hits = lambda p: F.size(F.filter(analyzer.tokens(p), lambda t: F.array_contains(terms, t)))
    scored = F.filter(
        F.transform(pieces, lambda p, i: F.struct((-hits(p)).alias("order"), i.alias("at"), p.alias("piece"))),
        lambda s: s["order"] < 0,
    )
    best = F.slice(F.array_sort(scored), 1, count)
    return F.transform(best, lambda s: F.rtrim(mark_all(s["piece"], terms, tag, analyzer)))


def highlight_map(parts: dict[str, Column]) -> Column:
    """Field names with their fragments; fields without any are left out."""
    built = F.map_from_arrays(
        F.array(*[F.lit(name) for name in parts]),
        F.array(*[F.filter(c, lambda x: x.isNotNull() & (x != "")) for c in parts.values()]),
    )
    return F.map_filter(built, lambda _, v: F.size(v) > 0)


def spelled_terms(terms: DataFrame) -> DataFrame:
    """(query_id, terms): all words to mark for a query, misspelt matches included."""
    return terms.groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def rows_of(source: DataFrame, id_column: str, page: DataFrame) -> DataFrame:
    """The source cut to the rows of a kept page (doc_id) where their ids are few.

    They are fetched and reach the scan as a list, so a source that is itself a join doesn't shuffle all its texts for them.
    """
    few = page.select("doc_id").distinct().limit(PUSHED_TERMS + 1).collect()
    return source if len(few) > PUSHED_TERMS else source.filter(F.col(id_column).isin([r["doc_id"] for r in few]))


def with_source(hits: DataFrame, source: DataFrame, id_column: str, terms: DataFrame, small: bool) -> DataFrame:
    """Hits next to their source row and the words to mark; the text is fetched for hits only.

    ``small`` says the hits of all queries together were found few enough to
    broadcast; then the texts of the source never move.
    """
    page = hits.withColumnRenamed("doc_id", id_column).join(terms, "query_id", "left")
    marked = source.join(hinted(page, small), id_column)
    return marked.withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def add_review_aliases(hits: DataFrame) -> DataFrame:
    """Review hits also under review_title and review_text, in columns and highlights."""
    out = hits
    for alias, name in (("review_title", "title"), ("review_text", "text")):
        if alias not in hits.columns:
            out = out.withColumn(alias, F.coalesce(name, F.lit("")) if name in hits.columns else F.lit(""))
    if "highlights" in hits.columns:
        h = F.col("highlights")
        for alias, name in (("review_title", "title"), ("review_text", "text")):
            wanted = F.map_contains_key(h, F.lit(name)) & ~F.map_contains_key(h, F.lit(alias))
            extra = F.map_filter(F.create_map(F.lit(alias), F.try_element_at(h, F.lit(name))), lambda _, v: v.isNotNull())
            h = F.when(wanted, F.map_concat(h, extra)).otherwise(h)
        out = out.withColumn("highlights", h)
    return out


def snippets(hits: DataFrame, rows: int = SNIPPET_ROWS) -> DataFrame:
    """The evidence line of the first hits of each query: the first highlight, else the text."""
    first = [F.try_element_at(F.try_element_at("highlights", F.lit(k)), F.lit(1)) for k in SNIPPET_KEYS]
    return hits.filter(F.col("rank") <= rows).select(
        "query_id", "rank", "review_id", "product_id", "product_title", "rating", "helpful_vote",
        F.coalesce(*first, F.col("review_text"), F.lit("")).alias("snippet"),
    )
