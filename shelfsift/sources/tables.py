"""Keyed tables: upsert, insert-if-absent, reload, manifest."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsift.operators.limits import first_n, first_per_key

MANIFEST_VERSION = 1
# Buckets of a keyed table, unless its store is made with another number.
BUCKETS = 32


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_per_key(df, keys, [F.desc(order)])


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return first_per_key(df, keys, [F.asc(order)])


def upsert(target: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Incoming rows replace stored ones; of several incoming rows with one key the last counts."""
    latest = keep_last(incoming, [key], order).select(*target.columns)
    return target.join(latest, key, "left_anti").select(*target.columns).unionByName(latest)


def insert_if_absent(target: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Stored rows stay; of several incoming rows with a new key the first counts."""
    earliest = keep_first(incoming, [key], order).select(*target.columns)
    return target.unionByName(earliest.join(target.select(key), key, "left_anti").select(*target.columns))


def capped(products: DataFrame, reviews: DataFrame, limit: int, order: str,
           take: Callable[[DataFrame, int], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` rows of both tables for a trial load, by ``order`` or as ``take`` takes them; 0 means all."""
    if limit <= 0:
        return products, reviews
    take = take or (lambda df, n: first_n(df, n, order))
    return take(products, limit), take(reviews, limit)


class TableStore:
    """Parquet tables under one folder.

    A keyed table lies in buckets by a hash of its key. Every load writes the buckets that its keys fall in to a folder of its own,
    and then the next version of a small table that says which folder holds the current rows of each bucket.
    Other buckets stay as they are. A version counts once it is complete, so a failed job leaves the
    current one whole, no task reads what it overwrites, and earlier versions can still be read.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    def _versions(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = []
        for status in fs.listStatus(path):
            label = status.getPath().getName()
            marker = self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            if label.startswith("v") and label[1:].isdigit() and fs.exists(marker):
                done.append(int(label[1:]))
        return sorted(done)

    def exists(self, name: str) -> bool:
        return bool(self._versions(name) or self._versions(f"{name}/current"))

    def _current(self, name: str) -> tuple[int, str, list[tuple[int, int, int]]]:
        """(version, schema, [(bucket, folder, number of buckets)]) of a keyed table; version 0 where there is none."""
        versions = self._versions(f"{name}/current")
        if not versions:
            return 0, "", []
        rows = self.spark.read.parquet(f"{self.root}/{name}/current/v{versions[-1]}").collect()  # a row per bucket
        return versions[-1], rows[0]["schema"], sorted((r.bucket, r.folder, r.buckets) for r in rows if r.bucket >= 0)

    def _rows(self, name: str, schema: str, places: list[tuple[int, int, int]]) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema))
        if not places:
            return self.spark.createDataFrame([], kind)
        paths = [f"{self.root}/{name}/rows/v{folder}/_bucket={bucket}" for bucket, folder, _ in places]
        return self.spark.read.schema(kind).parquet(*paths)

    def read(self, name: str) -> DataFrame:
        version, schema, places = self._current(name)
        if version:
            return self._rows(name, schema, places)
        return self.spark.read.parquet(f"{self.root}/{name}/v{self._versions(name)[-1]}")

    def files(self, name: str) -> list[str]:
        """Paths of the current files of a table."""
        return sorted(self.read(name).inputFiles())

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write the next complete version of a table without a key and return it."""
        versions = self._versions(name)
        path = f"{self.root}/{name}/v{versions[-1] + 1 if versions else 1}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def load(self, name: str, incoming: DataFrame, key: str, order: str, *, reset: bool = False,
             keep: str = "last") -> DataFrame:
        """Merge rows into a keyed table; ``reset`` starts from an empty one.

        Only the buckets that an incoming key falls in are read, merged and written.
        """
        version, schema, places = self._current(name)
        number = places[0][2] if places else self.buckets
        if reset or not version:
            schema, places, number = incoming.drop(order).schema.json(), [], self.buckets
        bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(number)).cast("int")
        touched = {r[0] for r in incoming.select(bucket.alias("b")).distinct().collect()}  # at most a row per bucket
        stored = self._rows(name, schema, [place for place in places if place[0] in touched])
        merge = upsert if keep == "last" else insert_if_absent
        merged = merge(stored, incoming, key, order).withColumn("_bucket", bucket)
        place = ["_bucket", F.xxhash64(F.col(key).cast("string"))]
        merged.repartitionByRange(*place).sortWithinPartitions(*place).write.mode("overwrite").partitionBy("_bucket").parquet(
            f"{self.root}/{name}/rows/v{version + 1}")
        now = [(b, folder, number, schema) for b, folder, _ in places if b not in touched]
        now += [(b, version + 1, number, schema) for b in touched] + [(-1, 0, number, schema)]
        self.spark.createDataFrame(now, "bucket int, folder int, buckets int, schema string").coalesce(1).write.mode(
            "overwrite").parquet(f"{self.root}/{name}/current/v{version + 1}")
        return self.read(name)


def manifest(products: DataFrame, reviews: DataFrame, **parameters: object) -> DataFrame:
    """One row: row counts of both tables and the parameters of the load."""
    counts = products.select(F.count(F.lit(1)).alias("product_count")).withColumn(
        "review_count", reviews.select(F.count(F.lit(1))).scalar()
    )
    described = [F.lit(value).alias(name) for name, value in parameters.items()]
    return counts.select(F.lit(MANIFEST_VERSION).alias("version"), *described, "product_count", "review_count")


def manifest_row(spark: SparkSession, **values: object) -> DataFrame:
    """A manifest from counts that the writers already returned."""
    return spark.range(1).select(
        F.lit(MANIFEST_VERSION).alias("version"),
        F.lit(int(time.time())).cast("long").alias("generated_at"),
        *[F.lit(value).alias(name) for name, value in values.items()],
    )
