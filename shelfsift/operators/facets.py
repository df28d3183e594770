"""Facets, buckets and metrics over matched or filtered rows.

Every function takes ``by``: the columns that separate independent groups
(usually ``["query_id"]``; empty for one global result).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Longest list that fills gaps between buckets.
GAP_STEP = 1 << 15

# Price buckets, lower end included, upper end not.
PRICE_RANGES = [
    ("*-50.0", None, 50.0), ("50.0-100.0", 50.0, 100.0), ("100.0-300.0", 100.0, 300.0),
    ("300.0-*", 300.0, None),
]


def half_up(value: Column, digits: int = 2) -> Column:
    """Rounding of SQL numerics."""
    return F.round(value, digits)


def half_even(value: Column, digits: int = 2) -> Column:
    """Rounding of floating point numbers to the nearest even last digit."""
    scale = float(10 ** digits)
    return F.rint(value * scale) / scale


def _best(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per group, without a window when there is one group."""
    if not by:
        return df.orderBy(*order).limit(n)
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def value_counts(df: DataFrame, column: str, by: list[str] = []) -> DataFrame:
    """Every value with its count."""
    return df.groupBy(*by, F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def terms_facet(df: DataFrame, column: str, n: int = 10, by: list[str] = []) -> DataFrame:
    """The most frequent values; equal counts order by value."""
    return _best(value_counts(df, column, by), by, [F.desc("n"), F.asc("value")], n)


def distribution_map(df: DataFrame, column: str, by: list[str] = []) -> DataFrame:
    """All values of a low-cardinality attribute as one map per group, for the edge of a flow.

    ``value_counts`` is the same in long form, for attributes of any number of values.
    """
    pair = F.struct("value", "n")
    return value_counts(df, column, by).groupBy(*by).agg(
        F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("distribution")
    )


def range_buckets(df: DataFrame, column: str, ranges=PRICE_RANGES, by: list[str] = []) -> DataFrame:
    """Counts per half-open range; empty ranges stay with 0."""
    counts = []
    for i, (_, low, high) in enumerate(ranges):
        inside = F.col(column).isNotNull()
        if low is not None:
            inside = inside & (F.col(column) >= low)
        if high is not None:
            inside = inside & (F.col(column) < high)
        counts.append(F.count_if(inside).alias(f"_n{i}"))
    rows = F.array(*[
        F.struct(
            F.lit(key).alias("value"), F.lit(low).cast("double").alias("low"),
            F.lit(high).cast("double").alias("high"), F.col(f"_n{i}").alias("n"),
        )
        for i, (key, low, high) in enumerate(ranges)
    ])
    return df.groupBy(*by).agg(*counts).select(*by, F.inline(rows))


def gaps_filled(counts: DataFrame, slot: str, order: Column, kept: list[str], name: str) -> DataFrame:
    """Rows with integer ``slot`` and, behind each, one per number that is missing before the next by ``order``.

    ``name`` holds the number, ``slot`` that of the row it came from; a row that has no slot stays as it is. The numbers are made
    in steps of four sizes, so no row ever holds a list longer than GAP_STEP, however far an outlier lies.
    """
    following = F.lead(slot).over(order)
    rows = counts.withColumn("_end", F.coalesce(following, F.col(slot) + 1) - 1).select(*kept, slot, "_end", F.col(slot).cast("long").alias(name))
    for step in (GAP_STEP ** 3, GAP_STEP ** 2, GAP_STEP, 1):
        until = F.least(F.col("_end").cast("long"), F.col(name) + step * GAP_STEP - 1)
        rows = rows.select(*kept, slot, "_end", F.explode_outer(F.sequence(name, until, F.lit(step).cast("long"))).alias(name))
    return rows.drop("_end")


def histogram(df: DataFrame, column: str, width: float = 1.0, by: list[str] = []) -> DataFrame:
    """Counts per interval, keyed by its lower end; gaps between the ends are filled with 0."""
    slot = F.floor(F.col(column) / width).alias("_slot")
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, slot).agg(F.count(F.lit(1)).alias("n"))
    window = (W.partitionBy(*by) if by else W).orderBy("_slot")
    every = gaps_filled(counts, "_slot", window, [*by, "n"], "_at")
    return every.select(
        *by, (F.col("_at") * float(width)).alias("value"), F.when(F.col("_at") == F.col("_slot"), F.col("n")).otherwise(F.lit(0)).alias("n")
    )


def group_metrics(df: DataFrame, column: str, by: list[str] = [], rounding=half_up) -> DataFrame:
    """Count, average rating and helpful votes per value."""
    return df.groupBy(*by, F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("negative_review_count"),
        rounding(F.avg("rating")).alias("avg_rating"),
        F.coalesce(F.sum(F.col("helpful_vote").cast("long")), F.lit(0)).alias("total_helpful_votes"),
    )


def brand_metrics(df: DataFrame, by: list[str] = [], n: int = 10, rounding=half_up) -> DataFrame:
    """The brands with most matches; the lower average first among equals."""
    order = [F.desc("negative_review_count"), F.asc("avg_rating"), F.asc("value")]
    return _best(group_metrics(df, "brand", by, rounding), by, order, n)


def category_counts(df: DataFrame, by: list[str] = [], n: int = 10) -> DataFrame:
    return terms_facet(df, "category", n, by).withColumnRenamed("n", "negative_review_count")


def summary(df: DataFrame, by: list[str] = [], rounding=half_up, empty: float | None = None) -> DataFrame:
    """Match count and average rating; ``empty`` is the average of no rows."""
    average = rounding(F.avg("rating"))
    if empty is not None:
        average = F.coalesce(average, F.lit(float(empty)))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matched_negative_reviews"), average.alias("avg_rating")
    )


def _grouping_facets(df: DataFrame, by: list[str], facets: dict[str, list[str]], rounding) -> DataFrame:
    """One aggregation over several groupings; ``facets`` maps a facet name to its columns."""
    columns = [c for group in facets.values() for c in group]
    sets = [[F.col(c) for c in [*by, *group]] for group in facets.values()]
    grouped = df.groupingSets(sets, *[F.col(c) for c in [*by, *columns]]).agg(
        *[F.grouping(c).alias(f"_off_{c}") for c in columns],
        F.count(F.lit(1)).alias("n"), rounding(F.avg("rating")).alias("avg_rating"),
        F.coalesce(F.sum(F.col("helpful_vote").cast("long")), F.lit(0)).alias("helpful_votes"),
    )
    facet = F.lit(None).cast("string")
    for name, group in facets.items():
        on = F.lit(True)
        for c in columns:
            on = on & (F.col(f"_off_{c}") == (0 if c in group else 1))
        facet = F.when(on, name).otherwise(facet)
    return grouped.withColumn("facet", facet)


def analytics_bundle(df: DataFrame, by: list[str] = ["query_id"], n: int = 10,
                     rounding=half_even) -> DataFrame:
    """Brands, categories, rating histogram and summary of the matches, in long form.

    Rows are (facet, value, n, avg_rating, helpful_votes). Two grouping-set
    aggregations: the term facets, whose many values are cut to ``n`` before
    they are ranked in one place, and the few rating buckets with the summary.
    """
    keyed = df.select(*by, "brand", "category", F.floor("rating").cast("int").alias("bucket"), "rating", "helpful_vote")
    columns = [*by, "facet", "value", "n", "avg_rating", "helpful_votes"]
    terms = _grouping_facets(keyed, by, {"brand": ["brand"], "category": ["category"]}, rounding).withColumn(
        "value", F.when(F.col("facet") == "brand", F.col("brand")).otherwise(F.col("category"))
    )
    # Only brands break ties by their average.
    tie = F.when(F.col("facet") == "brand", F.col("avg_rating"))
    best = _best(terms, [*by, "facet"], [F.desc("n"), tie.asc(), F.asc("value")], n)
    rest = _grouping_facets(keyed, by, {"rating": ["bucket"], "summary": []}, rounding)
    in_order = W.partitionBy(*by, "facet").orderBy("bucket")
    rest = gaps_filled(rest, "bucket", in_order, [*by, "facet", "n", "avg_rating", "helpful_votes"], "_slot")
    filler = F.col("_slot") != F.col("bucket")
    zero = F.lit(0).cast("long")
    rest = rest.select(
        *by, "facet", F.format_string("%d.0", F.col("_slot")).alias("value"),
        F.when(filler, zero).otherwise(F.col("n")).alias("n"),
        F.when(~F.coalesce(filler, F.lit(False)), F.col("avg_rating")).alias("avg_rating"),
        F.when(filler, zero).otherwise(F.col("helpful_votes")).alias("helpful_votes"),
    ).withColumn("value", F.when(F.col("facet") == "rating", F.col("value")))
    return best.select(*columns).unionByName(rest.select(*columns))


def sampled_brand_metrics(matches: DataFrame, sample: DataFrame, by: list[str] = ["query_id"],
                          n: int = 10) -> DataFrame:
    """Counts from all matches, average and votes from a sample of the best hits.

    A brand the sample misses has no average and 0 votes.
    """
    counts = terms_facet(matches, "brand", n, by).withColumnRenamed("n", "negative_review_count")
    metrics = group_metrics(sample, "brand", by, half_even).drop("negative_review_count")
    return counts.join(metrics, [*by, "value"], "left").fillna(0, ["total_helpful_votes"])


def sampled_summary(matches: DataFrame, sample: DataFrame, by: list[str] = ["query_id"]) -> DataFrame:
    """Exact number of matches, average rating of the sample."""
    total = matches.groupBy(*by).agg(F.count(F.lit(1)).alias("matched_negative_reviews"))
    average = sample.groupBy(*by).agg(half_even(F.avg("rating")).alias("avg_rating"))
    return total.join(average, by, "left")


def review_row_aggregates(rows: DataFrame, by: list[str] = [], n: int = 10) -> DataFrame:
    """Brand metrics, category counts and rating distribution of review rows with gaps in them.

    Missing attributes get their defaults; ratings are cut to whole numbers for
    the distribution.
    """
    full = rows.select(
        *by,
        F.coalesce(F.nullif("brand", F.lit("")), F.lit("Unknown")).alias("brand"),
        F.coalesce(F.nullif("category", F.lit("")), F.lit("Electronics")).alias("category"),
        F.coalesce("rating", F.lit(0.0)).alias("rating"),
        F.coalesce("helpful_vote", F.lit(0)).alias("helpful_vote"),
    ).withColumn("whole", F.col("rating").cast("int").cast("string"))
    none = lambda df: df.withColumn("avg_rating", F.lit(None).cast("double")).withColumn(
        "total_helpful_votes", F.lit(None).cast("long")
    )
    return (
        brand_metrics(full, by, n, half_even).withColumn("facet", F.lit("brand"))
        .unionByName(none(category_counts(full, by, n)).withColumn("facet", F.lit("category")))
        .unionByName(
            none(value_counts(full, "whole", by).withColumnRenamed("n", "negative_review_count"))
            .withColumn("facet", F.lit("rating"))
        )
    )


def product_review_metrics(products: DataFrame) -> DataFrame:
    """Average of the product averages, review and vote sums; products without reviews count as 0."""
    return products.agg(
        half_even(F.coalesce(F.avg("avg_review_rating"), F.lit(0.0))).alias("avg_rating"),
        F.coalesce(F.sum("loaded_review_count"), F.lit(0)).cast("long").alias("review_count"),
        F.coalesce(F.sum("helpful_votes"), F.lit(0)).cast("long").alias("helpful_votes"),
    )


def review_metrics(reviews: DataFrame) -> DataFrame:
    """Number of reviews, their average rating and votes."""
    return reviews.agg(
        F.count(F.lit(1)).alias("review_count"), half_up(F.avg("rating")).alias("avg_rating"),
        F.coalesce(F.sum(F.col("helpful_vote").cast("long")), F.lit(0)).alias("helpful_votes"),
    )


def rating_facet(products: DataFrame) -> DataFrame:
    """Product count and count per rating, in one table."""
    rating = value_counts(products, "rating").select(
        F.lit("rating").alias("facet"), F.col("value").cast("string").alias("value"), "n"
    )
    total = products.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("product_count").alias("facet"), F.lit(None).cast("string").alias("value"), "n"
    )
    return total.unionByName(rating)


def nested_buckets(df: DataFrame, outer: str, inner: str, n: int = 10, by: list[str] = []) -> DataFrame:
    """Outer buckets with metrics, each holding its ``n`` largest inner buckets."""
    pairs = df.groupBy(*by, F.col(outer).alias("value"), F.col(inner).alias("_inner")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("rating").alias("_r"),
        F.sum(F.col("helpful_vote").cast("long")).alias("_v"),
    )
    level = pairs.groupBy(*by, "value").agg(
        F.sum("_n").alias("count"), half_even(F.sum("_r") / F.sum("_n")).alias("avg_rating"),
        F.coalesce(F.sum("_v"), F.lit(0)).alias("total_helpful_votes"),
    )
    level = _best(level, by, [F.desc("count"), F.asc("value")], n)
    inner_best = _best(pairs, [*by, "value"], [F.desc("_n"), F.asc("_inner")], n)
    nested = inner_best.groupBy(*by, "value").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("o"), F.col("_inner").alias("value"),
                                             F.col("_n").alias("count")))).alias("_sub")
    )
    return level.join(nested, [*by, "value"]).select(
        *by, "value", "count", F.struct("avg_rating", "total_helpful_votes").alias("metrics"),
        F.transform("_sub", lambda s: F.struct(s["value"].alias("value"), s["count"].alias("count"))).alias(inner),
    )


def sections_total(sections: DataFrame, by: list[str] = ["query_id"]) -> DataFrame:
    """Sum of the section totals of a result made of several sections."""
    return sections.groupBy(*by).agg(F.sum(F.coalesce("total", F.lit(0))).alias("total"))
