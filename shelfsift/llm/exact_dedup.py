"""Exact duplicates by stateful streaming: keyed state on disk that never expires."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.llm.common import ascii_lower, located, stored
from shelfsift.operators.sizes import is_small
from shelfsift.session import scratch_path

_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "48",
    # Each partition has a store of its own, which would otherwise reserve megabytes before it holds a row.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _state_on_disk(spark: SparkSession):
    """The session keeps streaming state in RocksDB, of bounded memory, while this lasts."""
    before = {key: spark.conf.get(key, None) for key in _STATE}
    for key, value in _STATE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 2000,
) -> DataFrame:
    """One row per document: ``key``, keep_id, group_size, kept, digest, __file, __row.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts
    the row with the largest key stays (null lowest; of equal keys the last row of the last file).
    The stream's state holds, per digest, the stable identifier and content locator of the row to keep and the
    number of rows. Full texts are compared where a digest was met more than once; texts that differ in spite of an
    equal digest are told apart by the texts themselves. Very long texts are only hashed and compared, other columns are not
    read, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = located(docs)
    rows = rows.select(
        F.col(key).alias("id"), "__file", "__row", ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("norm")
    ).withColumn("digest", digest(F.col("norm")))
    staged = stored(rows.select("id", "digest", "__file", "__row"), "exact-staged")
    groups = _streamed(spark, staged, files_per_batch)

    # Within a digest the smallest and the largest text are equal only if all its texts are; map-side first. Few
    # digests that were met again are broadcast, so that no other text is shuffled.
    hits = groups.filter("n > 1").select("digest")
    met = rows.join(F.broadcast(hits), "digest", "left_semi") if is_small(hits) else rows
    clash = stored(
        met.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
        .filter("low <> high").select("digest"), "exact-clash",
    )
    best = F.max(F.struct("id", "__file", "__row")).alias("best")
    result = staged.join(groups, "digest")
    if not clash.isEmpty():
        apart = rows.join(clash, "digest", "left_semi")
        exact = apart.groupBy("digest", "norm").agg(best, F.count(F.lit(1)).alias("n"))
        result = result.join(clash, "digest", "left_anti").unionByName(
            apart.join(exact, ["digest", "norm"]).drop("norm"))
    kept = (F.col("__file") == F.col("best.__file")) & (F.col("__row") == F.col("best.__row"))
    return result.select(
        F.col("id").alias(key), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"),
        kept.alias("kept"), "digest", "__file", "__row",
    )


def _streamed(spark: SparkSession, staged: DataFrame, files_per_batch: int) -> DataFrame:
    """(digest, best, n) from the keyed state after the whole staged table went through the stream."""
    checkpoint = scratch_path(spark, "exact-state")
    path = staged.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(staged.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    best = F.max(F.struct("id", "__file", "__row")).alias("best")
    states = stream.groupBy("digest").agg(best, F.count(F.lit(1)).alias("n"))
    with _state_on_disk(spark):
        query = (
            states.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        return stored(state.select("key.digest", "value.*").toDF("digest", "best", "n"), "exact-groups")
