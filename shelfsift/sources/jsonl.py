"""JSON lines in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_SCHEMA = T.StructType([
    T.StructField("value", T.StringType()),
    T.StructField("ord", T.StructType([
        T.StructField("file", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("line", T.LongType()),
    ])),
])


def read_raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its place in file order; gzip is told by the suffix.

    ``line`` grows within a split, so (file, start of the split, line) orders
    lines across files however Spark packs the splits into tasks.
    """
    return spark.read.text(path).select(
        "value",
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("line"),
        ).alias("ord"),
    )


def split_of(ord_column: str = "ord") -> Column:
    """The file split a line comes from; it grows with file order."""
    return F.struct(F.col(f"{ord_column}.file"), F.col(f"{ord_column}.start"))


def first_in_file_order(df: DataFrame, n: int | None) -> DataFrame:
    """First ``n`` rows in file order of lines as they were read, filtered or parsed; ``None`` lifts the limit.

    The splits before the one that holds the ``n``-th row pass whole where they are. That one is read by one task in
    the order of its lines, so its first rows are cut off as they come: nothing is sorted, also where a packed file is one
    split. A row per split comes to the driver.
    """
    if n is None:
        return df
    split, left = split_of(), max(n, 0)
    for file, start, rows in sorted(df.groupBy("ord.file", "ord.start").agg(F.count(F.lit(1))).collect()):
        if rows >= left:
            border = F.struct(F.lit(file).alias("file"), F.lit(start).alias("start"))
            return df.filter(split < border).unionByName(df.filter(split == border).limit(left))
        left -= rows
    return df


def read_json_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Non-blank lines; a limit counts raw lines, blank ones included."""
    return first_in_file_order(read_raw_lines(spark, path), limit).filter(F.col("value").rlike(r"\S"))


def no_lines(spark: SparkSession) -> DataFrame:
    """What a missing source reads as."""
    return spark.createDataFrame([], RAW_SCHEMA)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system of the path itself, so any Spark-readable store works."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    """First path that exists, else the last candidate."""
    return next((p for p in candidates if path_exists(spark, p)), candidates[-1])


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Write a directory of JSON lines and return the rows written, counted on the way."""
    from pyspark.sql import Observation

    written = Observation()
    df.observe(written, F.count(F.lit(1)).alias("rows")).write.mode(mode).option(
        "ignoreNullFields", "false"
    ).json(path)
    return written.get["rows"]


def read_processed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A processed table; the schema is given, never inferred."""
    return spark.read.schema(schema).json(path)
