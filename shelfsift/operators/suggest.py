"""Search as you type: all words but the last match whole, the last one as a prefix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.functions.text import PRODUCT
from shelfsift.operators.limits import top_k
from shelfsift.operators.match import SCORE_DIGITS, term_impacts
from shelfsift.operators.postings import PUSHED_TERMS, IndexField, TextIndex, near_terms, query_terms, vocabulary
from shelfsift.operators.sizes import hinted, is_small, materialized

MIN_PREFIX = 2


def suggest_fields(column: str = "title") -> list[IndexField]:
    """The words of a title, and its runs of two and three words."""
    return [
        IndexField(column if n == 1 else f"{column}._{n}gram", column, PRODUCT, words=n) for n in (1, 2, 3)
    ]


def _started(vocab: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words that begin like any query's last one; few beginnings reach the scan, which opens their range of the sorted words."""
    few = [r["prefix"] for r in wanted.select("prefix").distinct().limit(PUSHED_TERMS + 1).collect()]
    if len(few) > PUSHED_TERMS:
        return vocab
    return vocab.filter(reduce(lambda a, b: a | b, (F.col("term").startswith(p) for p in few), F.lit(False)))


def prefix_terms(wanted: DataFrame, vocab: DataFrame) -> DataFrame:
    """(field, prefix, term): the vocabulary under its beginnings, as far as any query needs them."""
    vocab = _started(vocab, wanted)
    bounds = wanted.select(F.min(F.length("prefix")).alias("low"), F.max(F.length("prefix")).alias("high"))
    low, high = bounds.select("low").scalar(), bounds.select("high").scalar()
    until = F.least(F.length("term"), high)
    beginnings = vocab.filter(F.length("term") >= low).select(
        "field", "term", F.explode(F.sequence(low, until)).alias("_n")
    ).withColumn("prefix", F.expr("substring(term, 1, _n)")).drop("_n")
    asked = wanted.select("field", "prefix").distinct()
    return beginnings.join(hinted(asked, is_small(asked)), ["field", "prefix"])


def prefix_search(index: TextIndex, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score): relevance of the whole words plus 1 per field with the prefix."""
    terms = query_terms(queries, index.fields)
    is_last = F.col("slot") == F.col("n_terms") - 1
    whole = terms.filter(~is_last)
    last = terms.filter(is_last).withColumnRenamed("term", "prefix")
    small = is_small(whole)
    scored = term_impacts(index, whole, small).join(hinted(whole, small), ["field", "term"]).select(
        "query_id", "doc_id", "field", F.col("impact").alias("score")
    )
    started = last.join(prefix_terms(last, vocabulary(index)), ["field", "prefix"]).select("query_id", "field", "term")
    started = materialized(started)
    few = is_small(started)
    postings = near_terms(index.positions, started, few).select("doc_id", "field", "term")
    begun = postings.join(hinted(started, few), ["field", "term"]).groupBy(
        "query_id", "doc_id", "field"
    ).agg(F.lit(1.0).alias("score"))
    return scored.unionByName(begun).groupBy("query_id", "doc_id").agg(
        F.round(F.sum("score"), SCORE_DIGITS).alias("score")
    )


def suggestions(hits: DataFrame, queries: DataFrame, n: int = 5) -> DataFrame:
    """(query_id, title, rank): distinct titles in hit order, for prefixes of two characters or more."""
    asked = queries.filter(F.length("q") >= MIN_PREFIX).select("query_id")
    titles = hits.join(asked, "query_id", "left_semi").filter(F.col("title") != "").groupBy("query_id", "title").agg(
        F.min("rank").alias("first_rank")
    )
    return top_k(titles, n, [F.asc("first_rank")]).drop("first_rank")
