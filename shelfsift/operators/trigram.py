"""Character-trigram similarity between queries and a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsift.functions.text import word_trigrams
from shelfsift.operators.match import SCORE_DIGITS
from shelfsift.operators.sizes import hinted, is_small

THRESHOLD = 0.3


def similarity_of(grams: Column, others: Column) -> Column:
    """Shared over all trigrams of two sets, 0 where both are empty."""
    common = F.size(F.array_intersect(grams, others))
    union = F.size(grams) + F.size(others) - common
    return F.coalesce(F.round(F.try_divide(common, union), SCORE_DIGITS), F.lit(0.0))


def similarity(df: DataFrame, id_column: str, text: str, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, similarity) of every pair that shares a trigram, however few.

    The trigrams of a text leave one task together, so they are counted per pair before the shuffle.
    """
    grams = lambda rows, key, n: rows.select(key, F.size("grams").alias(n), F.explode("grams").alias("gram"))
    own = grams(df.select(F.col(id_column).alias("doc_id"), word_trigrams(F.col(text)).alias("grams")), "doc_id", "n")
    asked = grams(queries.select("query_id", word_trigrams(F.col("q")).alias("grams")), "query_id", "n_query")
    shared = own.join(hinted(asked, is_small(asked)), "gram").groupBy("query_id", "doc_id", "n", "n_query").agg(
        F.count(F.lit(1)).alias("common"))
    ratio = F.col("common") / (F.col("n") + F.col("n_query") - F.col("common"))
    return shared.select("query_id", "doc_id", F.round(ratio, SCORE_DIGITS).alias("similarity"))


def _least_shared(n: Column, threshold: float) -> Column:
    """Trigrams that a set of ``n`` shares at least with any set as similar as the threshold; rounding lets a few more in."""
    return F.ceil(n * (threshold - 1e-6))


def candidate_pairs(sets: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, query_id) pairs that may reach the threshold: ``sets`` has doc_id and grams, ``queries`` query_id and q_grams.

    All trigrams stand in one order, those that fewer queries hold first; so the ones that no query holds come before
    all others and only have to be counted. Similar sets share a trigram among the first of each, all but the
    last ``least shared - 1``. Of pairs that do, sizes too far apart go, and those whose trigrams met so far and
    the ones left behind the last of them fall short. Everything is counted where a document's text lies.
    """
    asked = queries.select("query_id", F.size("q_grams").alias("n_query"), F.explode("q_grams").alias("gram"))
    held = asked.groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    small = is_small(asked)
    in_query = W.partitionBy("query_id").orderBy("held", "gram")
    asked = asked.join(hinted(held, small), "gram").withColumn("q_at", F.row_number().over(in_query))
    asked = asked.filter(F.col("q_at") <= F.col("n_query") - _least_shared(F.col("n_query"), threshold) + 1).drop("held")
    own = sets.select("doc_id", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(hinted(held, small), "gram")
    of_doc = W.partitionBy("doc_id")
    place = F.row_number().over(of_doc.orderBy("held", "gram"))
    own = own.withColumn("at", F.col("n") - F.count(F.lit(1)).over(of_doc) + place)
    first = own.filter(F.col("at") <= F.col("n") - _least_shared(F.col("n"), threshold) + 1).drop("held")
    sizes = (F.col("n") >= F.col("n_query") * (threshold - 1e-6)) & (F.col("n_query") >= F.col("n") * (threshold - 1e-6))
    met = first.join(hinted(asked, small), "gram").filter(sizes).groupBy("doc_id", "query_id", "n", "n_query").agg(
        F.count(F.lit(1)).alias("met"), F.max("at").alias("at"), F.max("q_at").alias("q_at"))
    most = F.col("met") + F.least(F.col("n") - F.col("at"), F.col("n_query") - F.col("q_at"))
    needed = (F.col("n") + F.col("n_query")) * ((threshold - 1e-6) / (1 + threshold))
    return met.filter(most >= needed).select("doc_id", "query_id")


def similar(df: DataFrame, id_column: str, text: str, queries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(query_id, doc_id, similarity) of the pairs that reach the threshold; the texts are dealt out once."""
    sets = df.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).repartition("doc_id").select(
        "doc_id", word_trigrams(F.col("text")).alias("grams"))
    asked = queries.select("query_id", word_trigrams(F.col("q")).alias("q_grams"))
    pairs = candidate_pairs(sets, asked, threshold).join(sets, "doc_id").join(hinted(asked, is_small(asked)), "query_id")
    scored = pairs.select("query_id", "doc_id", similarity_of(F.col("grams"), F.col("q_grams")).alias("similarity"))
    return scored.filter(F.col("similarity") >= threshold)
