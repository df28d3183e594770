"""What several operators need: row locators, stored intermediates, ordered running sums, components."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsift.operators.sizes import hinted, is_small
from shelfsift.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table written once to the shared folder and read back: what follows survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__file`` and ``__row``, which name each row of a Parquet table for good.

    A table that isn't read straight from Parquet files is stored first.
    """
    if {"__file", "__row"} <= set(docs.columns):
        return docs

    def add(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        return df.withColumns({"__file": meta["file_path"], "__row": meta["row_index"]})

    try:
        return add(docs)
    except AnalysisException:
        return add(stored(docs, "located"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hands Python workers at most so many rows at a time from now on: in a session that runs one operator after the
    other, what a batch of whole texts takes stays small beside what the workers and the state already hold."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; texts of one byte per character take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def running_total(df: DataFrame, order: list[str], value: str, before: str) -> DataFrame:
    """``before``: the sum of ``value`` over all rows earlier in ``order``, which must be unique.

    Rows are dealt out by range and stored with their part; only the parts' totals pass the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "dealt")
    start, starts = 0, []
    for part, total in sorted(map(tuple, dealt.groupBy("__part").agg(F.sum(value)).collect())):
        starts.append((part, start))
        start += total or 0
    offsets = spark.createDataFrame(starts, "__part int, __start long")
    inside = F.sum(value).over(W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return (
        dealt.join(F.broadcast(offsets), "__part")  # a row per part
        .withColumn(before, F.col("__start") + F.coalesce(inside, F.lit(0)))
        .drop("__part", "__start")
    )


def joined(big: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join whose second side is broadcast only after its size was measured; nulls match nulls."""
    other = hinted(other.select(*(F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in other.columns)),
                   is_small(other))
    same = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in on]
    condition = same[0]
    for c in same[1:]:
        condition &= c
    return big.join(other, condition, how).drop(*(f"__r_{c}" for c in on))


def map_frames(rows: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    """mapInPandas whose results carry ``keys`` through as text, so that nulls and long numbers stay exact."""
    kinds = dict(rows.dtypes)
    as_text = rows.withColumns({k: F.col(k).cast("string") for k in keys})
    names = "".join(f"`{k}` string, " for k in keys)
    return as_text.mapInPandas(function, names + schema).withColumns({k: F.col(k).cast(kinds[k]) for k in keys})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as (node, root), root the smallest node; large-star and small-star.

    Every round is a join and a map-side minimum per node, so a node with any number of links
    is never gathered, and the links are stored between rounds.
    """
    def minima(both: DataFrame) -> DataFrame:
        return both.groupBy("a").agg(F.min("b").alias("m"))

    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "links")
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or state[0] == 0:
            return edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = tuple(state)
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        lows = minima(both).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(lows, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        small = large.join(minima(large), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.union(minima(large).toDF("a", "b")).filter("a <> b").distinct(), "links")

