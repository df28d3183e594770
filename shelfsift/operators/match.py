"""Matching queries against postings: relevance, boosts, minimum match, boolean and phrase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsift.functions.stem import english_stem
from shelfsift.functions.text import Analyzer
from shelfsift.operators.postings import PUSHED_TERMS, IndexField, TextIndex, near_terms, stem_table
from shelfsift.operators.sizes import hinted, is_small, materialized

# Okapi BM25 (Robertson & Zaragoza 2009).
K1 = 1.2
B = 0.75
SCORE_DIGITS = 6
# So many of the rarest words a document must share with a query before all its words are looked up, for minimum match.
RARE_SHARED = 3


def lookup(positions: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """Postings of the wanted (field, term) pairs.

    An equi-join: query terms found small are broadcast, so only their postings
    are ever shuffled; more of them are joined by shuffle, where the skew
    handling splits frequent terms.
    """
    wanted = terms.select("field", "term").distinct()
    return near_terms(positions, terms, small).join(hinted(wanted, small), ["field", "term"], "left_semi")


def term_frequencies(index: TextIndex, terms: DataFrame, small: bool) -> DataFrame:
    """(doc_id, field, term, dl, tf) of the wanted terms."""
    return lookup(index.positions, terms, small).groupBy("doc_id", "field", "term", "dl").agg(
        F.count(F.lit(1)).alias("tf")
    )


def document_frequencies(tf: DataFrame) -> DataFrame:
    """(field, term, df), at most a row per wanted term.

    Counting on tf keeps this branch equal to the scoring one, so both read one
    exchange.
    """
    return tf.groupBy("field", "term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def _impacts(tf: DataFrame, df: DataFrame, statistics: DataFrame, small: bool, k1: float = K1, b: float = B) -> DataFrame:
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = df.join(statistics, "field").select("field", "term", "avg_dl", idf.alias("idf"))
    norm = k1 * (1 - b + b * F.col("dl") / F.col("avg_dl"))
    return tf.join(hinted(weights, small), ["field", "term"]).select(
        "doc_id", "field", "term", (F.col("idf") * F.col("tf") / (F.col("tf") + norm)).alias("impact")
    )


def term_impacts(index: TextIndex, terms: DataFrame, small: bool) -> DataFrame:
    """(doc_id, field, term, impact): BM25 weight of every wanted term in every document."""
    tf = term_frequencies(index, terms, small)
    return _impacts(tf, document_frequencies(tf), index.statistics, small)


def _sum_slots(hits: DataFrame, placed: bool = False) -> DataFrame:
    """Best spelling per slot, slots added up. Rows are placed by (query, document) once for all steps.

    ``placed`` rows lie with others of their document and field already, and stay there.
    """
    rows = hits if placed else hits.repartition("query_id", "doc_id")
    slots = rows.groupBy("query_id", "doc_id", "field", "slot", "n_terms").agg(
        F.max(F.col("impact") * F.col("weight")).alias("score")
    )
    return slots.groupBy("query_id", "doc_id", "field", "n_terms").agg(
        F.sum("score").alias("score"), F.count(F.lit(1)).alias("matched")
    )


def _weighted(terms: DataFrame) -> DataFrame:
    return terms if "weight" in terms.columns else terms.withColumn("weight", F.lit(1.0))


def field_scores(index: TextIndex, terms: DataFrame) -> DataFrame:
    """(query_id, doc_id, field, score, matched, n_terms).

    ``terms`` may hold several spellings per slot with a weight each; the best
    one counts.
    """
    small = is_small(terms)
    return _sum_slots(term_impacts(index, terms, small).join(hinted(_weighted(terms), small), ["field", "term"]))


def _needed(above: int, share: float):
    return F.when(F.col("n_terms") <= above, F.col("n_terms")).otherwise(
        F.floor(F.round(F.col("n_terms") * share, 9))
    )


def minimum_match(scores: DataFrame, above: int = 2, share: float = 0.7) -> DataFrame:
    """Up to ``above`` words all must match in a field, beyond that the given share, rounded down."""
    return scores.filter(F.col("matched") >= _needed(above, share))


def minimum_match_scores(index: TextIndex, terms: DataFrame, above: int = 2, share: float = 0.7) -> DataFrame:
    """Field scores of the documents with enough of the words.

    Whoever holds ``m`` of ``n`` words holds ``j`` of any ``n - m + j`` of them.
    So each query meets the corpus through its rarest words only, and its
    frequent words are looked up for the documents that hold ``RARE_SHARED`` of
    those; a word that stands in most documents and most queries never pairs
    them all, and one rare word in common is not enough. The term
    frequencies are read four times and computed once. Candidates meet their
    words by document, and are added up and cut there, so that of all pairs
    only those with enough words move on.
    """
    small = is_small(terms)
    tf = materialized(term_frequencies(index, terms, small))
    df = document_frequencies(tf)
    impacts = _impacts(tf, df, index.statistics, small)
    slot = ["query_id", "field", "slot"]
    place = F.row_number().over(W.partitionBy("query_id", "field").orderBy("df", "slot"))
    # Known spellings of a slot count together; one without any comes first.
    slots = terms.join(df, ["field", "term"], "left").groupBy(*slot, "n_terms").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("df"))
    shared = F.least(_needed(above, share), F.lit(RARE_SHARED))
    rare = slots.withColumn("place", place).withColumn("shared", shared).filter(
        F.col("place") <= F.col("n_terms") - _needed(above, share) + F.col("shared")
    ).join(terms.select(*slot, "term").distinct(), slot).select(*slot, "shared", "term")
    # Several spellings of one slot in a document let it pass more easily, none is lost by them.
    met = tf.select("doc_id", "field", "term").join(hinted(rare, small), ["field", "term"])
    met = met.groupBy("query_id", "doc_id", "field", "shared").agg(F.count(F.lit(1)).alias("met"))
    candidates = met.filter(F.col("met") >= F.col("shared")).select("query_id", "doc_id", "field")
    hits = impacts.join(candidates, ["doc_id", "field"]).join(
        hinted(_weighted(terms), small), ["query_id", "field", "term"]
    )
    return minimum_match(_sum_slots(hits, placed=True), above, share)


def best_field(scores: DataFrame, boosts: dict[str, float] | None = None) -> DataFrame:
    """(query_id, doc_id, score): the best boosted field."""
    boosted = F.col("score")
    if boosts:
        factor = F.lit(1.0)
        for name, boost in boosts.items():
            factor = F.when(F.col("field") == name, float(boost)).otherwise(factor)
        boosted = boosted * factor
    return scores.groupBy("query_id", "doc_id").agg(F.round(F.max(boosted), SCORE_DIGITS).alias("score"))


def any_term_match(index: TextIndex, terms: DataFrame, boosts: dict[str, float] | None = None) -> DataFrame:
    """Documents with at least one query word, by relevance."""
    return best_field(field_scores(index, terms), boosts)


# Boolean and phrase matching -------------------------------------------------


def query_units(queries: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(query_id, grp, unit, negated, n, offset, term, n_positive).

    Words must all match; ``or`` starts an alternative group; a leading ``-``
    excludes; quotes make a phrase. One row per term, as column expressions, so
    any number of queries is split at once. Words are stemmed where the
    analyzer says so; ``n_positive`` is 0 in a group that only excludes.
    """
    raw = F.regexp_extract_all("q", F.lit(r'-?"[^"]*"|[^\s"]+'), F.lit(0))
    is_or = lambda r: F.lower(r) == "or"
    units = queries.select("query_id", raw.alias("raws")).select(
        "query_id",
        F.inline(F.transform("raws", lambda r, i: F.struct(
            i.alias("unit"), r.alias("raw"),
            F.size(F.filter(F.slice("raws", 1, i + 1), is_or)).alias("grp"),
        ))),
    ).filter(~is_or(F.col("raw")))
    words = analyzer.tokens(F.regexp_replace("raw", "^-", ""))
    placed = F.filter(
        F.transform(words, lambda w, i: F.struct(i.alias("offset"), w.alias("term"))),
        lambda s: analyzer.keeps(s["term"]),
    )
    units = units.select("query_id", "grp", "unit", F.col("raw").startswith("-").alias("negated"), placed.alias("placed"))
    units = units.filter(F.size("placed") > 0)
    positive = units.groupBy("query_id", "grp").agg(F.count_if(~F.col("negated")).alias("n_positive"))
    rows = units.join(positive, ["query_id", "grp"]).select(
        "query_id", "grp", "unit", "negated", "n_positive", F.size("placed").alias("n"), F.inline("placed")
    )
    return rows.withColumn("term", english_stem("term")) if analyzer.stems else rows


def stemmed_postings(positions: DataFrame, units: DataFrame, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Postings by stem, cut to the stems of the queries, and (stem, word) of all words that have them.

    The table holds words. The vocabulary (``words`` with term and stem, if it
    is stored) tells which of them share a stem with a query, and only their
    postings are read, a join like any other. They are kept: matching and
    ranking read them several times, and the texts behind them once.
    """
    asked = units.select(F.col("term").alias("stem")).distinct()
    known = words if words is not None else stem_table(positions, english_stem)
    sharing = materialized(known.select("term", "stem").join(hinted(asked, is_small(asked)), "stem"))
    few = is_small(sharing)
    rows = near_terms(positions, sharing, few).join(hinted(sharing, few), "term")
    by_stem = materialized(rows.drop("term", "term_bucket").withColumnRenamed("stem", "term"))
    return by_stem, sharing.withColumnRenamed("term", "word")


def boolean_match(positions: DataFrame, units: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(query_id, grp, doc_id) for every alternative that holds.

    A phrase holds where all its words lie at one start; a single word needs no
    place, so its occurrences collapse before the shuffle. Excluding is counted
    in the same aggregation as matching. A group that only excludes holds for
    all ``documents`` (doc_id) but those found; no posting stands for them.
    """
    start = F.when(F.col("n") == 1, 0).otherwise(F.col("pos") - F.col("offset"))
    keys = ["query_id", "grp", "unit", "negated", "n_positive", "n", "doc_id"]
    small = is_small(units)
    found = near_terms(positions, units, small).join(hinted(units, small), "term").withColumn("start", start).groupBy(*keys, "start").agg(
        F.count(F.lit(1)).alias("c")
    ).filter(F.col("c") >= F.col("n"))
    found = found.repartition("query_id", "doc_id").groupBy(*keys).agg(F.count(F.lit(1)).alias("places"))
    groups = found.groupBy("query_id", "grp", "doc_id", "n_positive").agg(
        F.count_if(~F.col("negated")).alias("hit"), F.count_if(F.col("negated")).alias("excluded")
    )
    held = groups.filter((F.col("hit") >= F.col("n_positive")) & (F.col("n_positive") > 0) & (F.col("excluded") == 0)).select(
        "query_id", "grp", "doc_id"
    )
    only = units.filter("n_positive = 0").select("query_id", "grp").distinct()
    few = only.limit(PUSHED_TERMS + 1).collect() if documents is not None else []
    if not few:
        return held
    # The answer to such a group is the table itself but for a few rows, so it is made as that.
    every = documents.select("doc_id")
    if len(few) <= PUSHED_TERMS:
        kind = dict(only.dtypes)
        group = lambda r: F.struct(*(F.lit(r[c]).cast(kind[c]).alias(c) for c in only.columns))
        every = every.select("doc_id", F.inline(F.array(*map(group, few))))
    else:
        every = every.crossJoin(hinted(only, small))
    excluded = groups.filter("n_positive = 0").select("query_id", "grp", "doc_id")
    return held.unionByName(every.join(excluded, ["query_id", "grp", "doc_id"], "left_anti"))


def matching_documents(positions: DataFrame, units: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id) of documents for which any alternative holds."""
    return boolean_match(positions, units, documents).select("query_id", "doc_id").distinct()


def ranked_slots(units: DataFrame) -> DataFrame:
    """(query_id, grp, slot, term, n_terms): the distinct words that count for ranking."""
    wanted = units.filter(~F.col("negated"))
    grouped = wanted.groupBy("query_id", "grp").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    return grouped.select(
        "query_id", "grp", F.posexplode("terms").alias("slot", "term"), F.size("terms").alias("n_terms")
    )


def highlight_terms(units: DataFrame, sharing: DataFrame | None = None) -> DataFrame:
    """(query_id, terms): words to mark in the hits of a query, with ``sharing`` all that have their stems."""
    wanted = units.filter(~F.col("negated"))
    if sharing is not None:
        stems = sharing.select(F.col("stem").alias("term"), "word")
        wanted = wanted.join(hinted(stems, is_small(stems)), "term").drop("term").withColumnRenamed("word", "term")
    return wanted.groupBy("query_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def weighted_fields(classes: dict[str, str], analyzer: Analyzer) -> list[IndexField]:
    """Index fields with the weight of their class."""
    return [IndexField(name, analyzer=analyzer, weight=CLASS_WEIGHTS[c]) for name, c in classes.items()]


# Weights of the four classes, and the class of each field.
CLASS_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
PRODUCT_CLASSES = {
    "title": "A", "brand": "B", "category": "B", "features": "B", "description": "C", "review_text": "D",
}
REVIEW_CLASSES = {"title": "A", "text": "B"}
