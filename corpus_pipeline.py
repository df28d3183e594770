"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of its predecessor and returns a DataFrame; all but the
last return the columns of documents. Rows are told apart by their place in their Parquet file, so null and repeated
doc_ids are stages' rows like any others, and an empty table goes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.llm import exact_dedup, mixing, packing, queries, simhash, toxicity
from shelfsift.llm.common import joined, located, small_batches, stored

PLACE = ["__file", "__row"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents more likely toxic than not go; null texts stay."""
    small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.severity(model, F.col("text"))["toxic_probability"] < 0.5)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z the row with the largest doc_id stays."""
    docs, columns = located(docs), docs.columns
    found = exact_dedup.exact_dedup(docs.select("doc_id", "text", *PLACE))
    gone = stored(found.filter(~F.col("kept")).select(*PLACE), "pipeline-copies")
    return joined(docs, gone, PLACE, "left_anti").select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash the one with the smallest doc_id stays; null doc_ids only if no other is there."""
    small_batches(spark)
    docs, columns = located(docs), docs.columns
    found = simhash.near_dedup(docs, ["doc_id", *PLACE])
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", *PLACE)
    stays = found.groupBy("root").agg(F.min(order).alias("s")).select("root", "s.__file", "s.__row")
    gone = found.join(stays, ["root", *PLACE], "left_anti")
    return joined(docs, stored(gone.select(*PLACE), "pipeline-near"), PLACE, "left_anti").select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; the one a source's rest cuts is taken whole if half of it fits."""
    mixed = mixing.mix(docs)
    times = F.col("repeats") + F.when((F.col("part") * 2 >= F.col("size")) & F.col("__drawn"), 1).otherwise(0)
    copies = F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias("__copy")
    return mixed.select(*docs.columns, copies).drop("__copy")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids."""
    small_batches(spark)
    import public_tokenizers

    return packing.pack(docs, ["doc_id"], public_tokenizers.path(queries.TOKENIZER))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The model, the 64-bit hash and the tokens of the stages have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
