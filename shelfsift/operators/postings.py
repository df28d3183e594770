"""Postings and corpus statistics as DataFrames.

An index is a table of term positions plus one row of statistics per field. It
can stay lazy (small jobs) or be written once and read by many searches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsift.functions.stem import stem
from shelfsift.functions.text import PRODUCT, Analyzer, shingles
from shelfsift.operators.sizes import hinted, is_small, materialized


TERM_BUCKETS = 64
PUSHED_TERMS = 1000


@dataclass(frozen=True)
class IndexField:
    """One searchable field: where its text is and how it becomes terms.

    ``words`` above 1 indexes runs of that many neighbouring words.
    """

    name: str
    column: str | None = None
    analyzer: Analyzer = PRODUCT
    words: int = 1
    weight: float = 1.0

    def tokens(self, text: Column) -> Column:
        tokens = self.analyzer.tokens(text)
        return tokens if self.words == 1 else shingles(tokens, self.words)

    def count(self, text: Column) -> Column:
        return F.greatest(self.analyzer.count(text) - (self.words - 1), F.lit(0))

    def keeps(self, term: Column) -> Column:
        return self.analyzer.keeps(term) if self.words == 1 else F.lit(True)


def _token_columns(df: DataFrame, fields: list[IndexField], id_column: str) -> DataFrame:
    return df.select(
        F.col(id_column).alias("doc_id"),
        *[f.tokens(F.col(f.column or f.name)).alias(f"_t{i}") for i, f in enumerate(fields)],
    )


def _length(field: IndexField, i: int) -> Column:
    tokens = F.col(f"_t{i}")
    return F.size(F.filter(tokens, field.keeps)) if field.analyzer.stop_words else F.size(tokens)


def _last_kept(field: IndexField, i: int) -> Column:
    """Place of the last word that isn't a stop word, 0 if there is none."""
    tokens = F.col(f"_t{i}")
    if not field.analyzer.stop_words:
        return F.size(tokens)
    places = F.transform(tokens, lambda w, at: F.when(field.keeps(w), at + 1).otherwise(0))
    return F.coalesce(F.array_max(places), F.lit(0))


def term_positions(df: DataFrame, fields: list[IndexField], id_column: str, chained: bool = False) -> DataFrame:
    """(doc_id, field, field_no, term, pos, dl, weight), one row per kept word.

    The fields of a row are unfolded next to each other, so the table is read
    once. With ``chained`` the positions of a field go on after the last kept
    word of the previous one.
    """
    per_field, before = [], F.lit(0)
    for i, field in enumerate(fields):
        per_field.append(F.struct(
            F.lit(field.name).alias("field"), F.lit(i).alias("field_no"), F.lit(field.weight).alias("weight"),
            _length(field, i).alias("dl"), before.alias("before"), F.col(f"_t{i}").alias("tokens"),
        ))
        if chained:
            before = before + _last_kept(field, i)
    unfolded = _token_columns(df, fields, id_column).select("doc_id", F.inline(F.array(*per_field)))
    rows = unfolded.select(
        "doc_id", "field", "field_no", "dl", "weight", "before", F.posexplode("tokens").alias("at", "term")
    )
    for field in fields:
        if field.words == 1 and field.analyzer.stop_words:
            rows = rows.filter((F.col("field") != field.name) | field.keeps(F.col("term")))
    return rows.select(
        "doc_id", "field", "field_no", "term", (F.col("before") + F.col("at") + 1).alias("pos"), "dl", "weight"
    )


def field_statistics(df: DataFrame, fields: list[IndexField], id_column: str) -> DataFrame:
    """(field, n_docs, avg_dl) over the documents that have the field; a row per field."""
    lengths = F.array(*[
        F.struct(F.lit(f.name).alias("field"), f.count(F.col(f.column or f.name)).alias("dl")) for f in fields
    ])
    rows = df.select(F.inline(lengths)).filter(F.col("dl") > 0)
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))


@dataclass(frozen=True)
class TextIndex:
    fields: list[IndexField]
    positions: DataFrame
    statistics: DataFrame
    words: DataFrame | None = None
    # (field, key, term): the words under their deletion keys.
    keys: DataFrame | None = None

    @classmethod
    def of(cls, df: DataFrame, fields: list[IndexField], id_column: str, chained: bool = False) -> "TextIndex":
        return cls(
            fields, term_positions(df, fields, id_column, chained), field_statistics(df, fields, id_column)
        )

    def field_names(self) -> list[str]:
        return [f.name for f in self.fields]

    def save(self, path: str, keys: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Write positions, statistics and the distinct words with their stems, sorted so that a beginning is a range.

        ``keys`` makes the deletion keys of the words, for searches that allow typos.
        """
        save_positions(self.positions, f"{path}/positions")
        # The words come from what was written; the texts aren't analysed again for them.
        written = replace(self, positions=self.positions.sparkSession.read.parquet(f"{path}/positions"))
        words = stemmed_vocabulary(written).repartitionByRange("field", "term").sortWithinPartitions("field", "term")
        words.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.statistics.write.mode("overwrite").parquet(f"{path}/statistics")
        if keys is not None:
            known = keys(self.positions.sparkSession.read.parquet(f"{path}/vocabulary").select("field", "term"))
            save_by_bucket(known, f"{path}/keys", "key", "term")

    @classmethod
    def load(cls, spark: SparkSession, path: str, fields: list[IndexField], keys: bool = False) -> "TextIndex":
        parts = ("positions", "statistics", "vocabulary", *(["keys"] if keys else []))
        return cls(fields, *[spark.read.parquet(f"{path}/{part}") for part in parts])

    def stemmed(self, stems: DataFrame) -> "TextIndex":
        """The same index over stems; ``stems`` maps each distinct term once.

        The stop words are already gone, and lengths and positions stay. Rows find their stem in a hash table of
        the words of a partition, so that the postings of the corpus are dealt out but not sorted.
        """
        mapped = self.positions.join(stems.hint("shuffle_hash"), "term", "left").withColumn("term", F.coalesce("stem", "term")).drop("stem")
        return replace(self, positions=mapped.drop("term_bucket"), words=None, keys=None)


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def save_positions(positions: DataFrame, path: str) -> None:
    """Write positions in folders by term bucket, sorted by term.

    A search opens only the folders of its terms. The range split ends with the
    document, so a frequent term is spread over many tasks and files.
    """
    save_by_bucket(positions, path, "term", "doc_id")


def save_by_bucket(rows: DataFrame, path: str, key: str, then: str) -> None:
    """Write rows in folders by the bucket of ``key``, range-split and sorted by ``key`` and ``then``."""
    place = ["term_bucket", key, then]
    rows.withColumn("term_bucket", term_bucket(F.col(key))).repartitionByRange(*place).sortWithinPartitions(
        *place
    ).write.mode("overwrite").partitionBy("term_bucket").parquet(path)


def near_terms(positions: DataFrame, terms: DataFrame, small: bool, key: str = "term") -> DataFrame:
    """Stored positions, or other rows by ``key``, cut down to the folders of the wanted terms.

    At most TERM_BUCKETS numbers are fetched for it; few terms are fetched
    themselves, so that the scan can skip row groups of the sorted files too.
    """
    if not small or "term_bucket" not in positions.columns:
        return positions
    wanted = terms.select(F.col(key).alias("term"), term_bucket(F.col(key)).alias("b")).distinct()
    few = wanted.limit(PUSHED_TERMS + 1).collect()
    if len(few) <= PUSHED_TERMS:
        positions = positions.filter(F.col(key).isin([r["term"] for r in few]))
        buckets = {r["b"] for r in few}
    else:
        buckets = {r["b"] for r in wanted.select("b").distinct().collect()}
    return positions.filter(F.col("term_bucket").isin(sorted(buckets)))


def vocabulary(index: TextIndex) -> DataFrame:
    """Distinct (field, term)."""
    if index.words is not None:
        return index.words.select("field", "term")
    return index.positions.select("field", "term").distinct()


def with_stems(words: DataFrame, stemmer: Callable[[Column], Column] = stem) -> DataFrame:
    """Distinct words (a column ``term``) with their ``stem``.

    The stemmer works on whole batches of rows, not as an expression: a condition on the stem, like the one that
    a join adds, would else be moved below ``distinct`` and stem every word of the corpus.
    """
    stems_of = stemmer.func

    def stemmed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(stem=stems_of(frame["term"]))

    return words.mapInPandas(stemmed, T.StructType([*words.schema, T.StructField("stem", T.StringType())]))


def stemmed_vocabulary(index: TextIndex) -> DataFrame:
    """Distinct (field, term) with the stem; the Python stemmer sees no corpus rows."""
    if index.words is not None:
        return index.words
    return with_stems(vocabulary(index), stem)


def folded_to_stems(index: TextIndex, sharing: DataFrame) -> TextIndex:
    """The index over stems, cut to the words in ``sharing`` (field, term, stem).

    What is left is kept: scores, frequencies and totals read it, and the texts behind it once.
    """
    small = is_small(sharing)
    rows = near_terms(index.positions, sharing, small).join(hinted(sharing, small), ["field", "term"])
    by_stem = materialized(rows.drop("term", "term_bucket").withColumnRenamed("stem", "term"))
    return replace(index, positions=by_stem, words=None, keys=None)


def stem_table(positions: DataFrame, stemmer: Callable[[Column], Column] = stem) -> DataFrame:
    """(term, stem): the Python stemmer sees every distinct term once, no corpus rows."""
    return with_stems(positions.select("term").distinct(), stemmer)


def term_statistics(positions: DataFrame) -> DataFrame:
    """(field, term, df, occurrences)."""
    per_doc = positions.groupBy("field", "term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences"))


def query_terms(queries: DataFrame, fields: list[IndexField],
                mapped: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, field, slot, term, n_terms): the query text as each field would index it.

    ``mapped`` is applied to every term, for instance the stemmer.
    """
    per_field = queries.select(
        "query_id",
        F.inline(F.array(*[
            F.struct(F.lit(f.name).alias("field"), F.filter(f.tokens(F.col("q")), f.keeps).alias("terms"))
            for f in fields
        ])),
    )
    rows = per_field.select("query_id", "field", F.posexplode("terms").alias("slot", "term"), F.size("terms").alias("n_terms"))
    return rows if mapped is None else rows.withColumn("term", mapped(F.col("term")))
