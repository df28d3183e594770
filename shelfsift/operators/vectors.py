"""Vectors: embedding of text columns, exact and candidate-limited nearest neighbours."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.functions.text import PRODUCT, Analyzer
from shelfsift.operators.limits import top_k
from shelfsift.operators.match import SCORE_DIGITS
from shelfsift.operators.sizes import hinted, is_small

DIMENSIONS = 768
BATCH = 100
RETRIES = 5

# One block of a search: so many queries against so many vectors, some 100 MB at 768 dimensions.
_QUERIES_PER_BLOCK = 1024
_VECTORS_PER_BLOCK = 20_000

# Bits of a signature; a vector this near a plane counts as on its far side, whatever rounding says.
BITS = 1024
_ON_PLANE = 1e-6


# Embedding -----------------------------------------------------------------------


def hashed_features(df: DataFrame, id_column: str, text: str, dimensions: int = DIMENSIONS,
                    analyzer: Analyzer = PRODUCT) -> DataFrame:
    """(doc_id, dim, weight): signed feature hashing (Weinberger et al. 2009), length 1.

    The model that needs no model: words are hashed to a dimension and a sign.
    """
    digest = F.md5(F.col("term").cast("binary"))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    sign = F.when(F.substring(digest, 9, 1) < "8", 1.0).otherwise(-1.0)
    words = df.select(F.col(id_column).alias("doc_id"), F.explode(analyzer.terms(F.col(text))).alias("term"))
    # The words of one text are summed map-side, so at most ``dimensions`` rows of it move.
    sums = words.select("doc_id", (number % dimensions).cast("int").alias("dim"), sign.alias("s")).groupBy("doc_id", "dim").agg(F.sum("s").alias("s")).filter(F.col("s") != 0)
    norms = sums.groupBy("doc_id").agg(
        F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"), F.collect_list(F.struct("dim", "s")).alias("parts")
    )
    return norms.select("doc_id", "norm", F.inline("parts")).select("doc_id", "dim", (F.col("s") / F.col("norm")).alias("weight"))


def dense(features: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, embedding): sparse features as one float array per document.

    In the order of their dimensions the weights are joined with the zeros before them, so no dimension is searched for.
    """
    entries = F.map_entries(F.map_from_entries(F.collect_list(F.struct("dim", "weight"))))
    parts = F.filter(F.array_sort(entries), lambda p: p["key"].between(0, dimensions - 1))
    rows = features.groupBy("doc_id").agg(parts.alias("parts"))
    zeros = lambda n: F.array_repeat(F.lit(0.0).cast("float"), n.cast("int"))
    before = lambda i: F.coalesce(F.get("parts", i.cast("int") - 1)["key"], F.lit(-1))
    runs = F.transform("parts", lambda p, i: F.concat(zeros(p["key"] - before(i) - 1), F.array(p["value"].cast("float"))))
    rest = zeros(dimensions - 1 - before(F.size("parts")))
    return rows.select("doc_id", F.concat(F.flatten(runs), rest).alias("embedding"))


def embed_column(df: DataFrame, id_column: str, text: str, model: Callable[[list[str]], list[list[float]]],
                 batch: int = BATCH, retries: int = RETRIES, delay: float = 2.0) -> DataFrame:
    """(doc_id, embedding) from a model that takes lists of texts.

    Texts go to the model in batches; a failing batch is tried again with
    growing pauses before the task fails.
    """

    def call(texts: list[str]) -> list[list[float]]:
        for attempt in range(retries):
            try:
                return model(texts)
            except Exception:
                if attempt == retries - 1:
                    raise
                time.sleep(delay * 2 ** attempt)
        return []

    def embed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "embedding": call(part["text"].tolist())})

    rows = df.select(F.col(id_column).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(embed, f"doc_id {kind}, embedding array<float>")


# Exact neighbours ------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit_rows(vectors) -> np.ndarray:
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def _best(similarity: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` best, smaller ids first among equals."""
    if len(similarity) > k:
        bound = np.partition(similarity, len(similarity) - k)[len(similarity) - k]
        chosen = np.flatnonzero(similarity >= bound)
    else:
        chosen = np.arange(len(similarity))
    return chosen[np.lexsort((ids[chosen], -similarity[chosen]))[:k]]


def _block_best(query_ids, query_rows: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> pd.DataFrame:
    similarity = np.round(rows @ query_rows.T, SCORE_DIGITS)
    out = []
    for j, query in enumerate(query_ids):
        best = _best(similarity[:, j], ids, k)
        out.append(pd.DataFrame({"query_id": query, "doc_id": ids[best], "cosine": similarity[best, j]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc_id": [], "cosine": []})


def exact_neighbours(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "doc_id",
                     embedding: str = "embedding") -> DataFrame:
    """(query_id, doc_id, cosine, score, rank): the ``k`` nearest by cosine.

    Few queries travel to every task once and the vectors stay where they are;
    each task multiplies matrices and sends on only its ``k`` best per query.
    More queries are cut into blocks against blocks of vectors, spread over the
    cluster by hash, with the same cut per block.
    """
    q = queries.select("query_id", F.col("embedding"))
    v = vectors.select(F.col(id_column).alias("doc_id"), F.col(embedding).alias("embedding"))
    kinds = [q.schema["query_id"].dataType.simpleString(), v.schema["doc_id"].dataType.simpleString()]
    schema = f"query_id {kinds[0]}, doc_id {kinds[1]}, cosine double"
    if is_small(q, _QUERIES_PER_BLOCK):
        found = _few_queries(v, q, k, schema)
    else:
        found = _query_blocks(v, q, k, schema)
    best = top_k(found, k, [F.desc("cosine"), F.asc("doc_id")])
    return best.withColumn("score", F.round((1 + F.col("cosine")) / 2, SCORE_DIGITS))


def _few_queries(v: DataFrame, q: DataFrame, k: int, schema: str) -> DataFrame:
    asked = q.toPandas()
    shared = v.sparkSession.sparkContext.broadcast(
        (asked["query_id"].to_numpy(), _unit_rows(asked["embedding"]) if len(asked) else np.zeros((0, 1)))
    )

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, query_rows = shared.value
        kept = None
        for frame in frames:
            if not len(frame) or not len(query_ids):
                continue
            found = _block_best(query_ids, query_rows, frame["doc_id"].to_numpy(), _unit_rows(frame["embedding"]), k)
            kept = found if kept is None else pd.concat([kept, found])
            kept = kept.sort_values(["query_id", "cosine", "doc_id"], ascending=[True, False, True]).groupby("query_id").head(k)
        if kept is not None:
            yield kept

    return v.mapInPandas(nearest, schema)


def _blocks(vectors: DataFrame, id_column: str, queries: DataFrame, query_column: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with block and part: every block of queries meets every part of the vectors once, spread by hash."""
    blocks = max(1, math.ceil(queries.count() / _QUERIES_PER_BLOCK))
    parts = max(1, math.ceil(vectors.count() / _VECTORS_PER_BLOCK))
    everywhere = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("part", F.pmod(F.xxhash64(id_column), F.lit(parts)).cast("int")).withColumn("block", everywhere(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64(query_column), F.lit(blocks)).cast("int")).withColumn("part", everywhere(parts))
    return left, right


def _query_blocks(v: DataFrame, q: DataFrame, k: int, schema: str) -> DataFrame:
    left, right = _blocks(v, "doc_id", q, "query_id")

    def nearest(vectors: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(asked):
            return pd.DataFrame({"query_id": [], "doc_id": [], "cosine": []})
        return _block_best(
            asked["query_id"].to_numpy(), _unit_rows(asked["embedding"]),
            vectors["doc_id"].to_numpy(), _unit_rows(vectors["embedding"]), k,
        )

    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(nearest, schema)


# Candidate-limited neighbours ----------------------------------------------------------


def candidate_count(k: int) -> int:
    """Candidates a nearest-neighbour request looks at."""
    return max(10 * k, 50)


@lru_cache(maxsize=4)
def _planes(dimensions: int, bits: int, seed: int) -> np.ndarray:
    """Directions of random hyperplanes, 1 or -1 in every dimension by a hash, so that SQL can make the same."""
    signs = [hashlib.md5(f"{seed}:{p}:{d}".encode()).hexdigest()[0] < "8" for p in range(bits) for d in range(dimensions)]
    return np.where(np.array(signs).reshape(bits, dimensions), 1, -1).astype(np.int8)


def _packed_sides(vectors, planes: np.ndarray) -> np.ndarray:
    """The side of every plane that each vector lies on, 64 to a word."""
    return np.packbits(_unit_rows(vectors) @ planes.T.astype(np.float64) > _ON_PLANE, axis=1).view(np.int64)


def signatures(vectors: DataFrame, id_column: str, embedding: str, dimensions: int, bits: int = BITS, seed: int = 7) -> DataFrame:
    """(id, signature): sides of random hyperplanes (Charikar 2002), ``bits`` (a multiple of 64) for each vector.

    The share of equal bits of two signatures estimates their angle. Worth storing: a scan reads 128 bytes per
    vector instead of kilobytes.
    """
    planes = _planes(dimensions, bits, seed)
    rows = vectors.select(F.col(id_column).alias("id"), F.col(embedding).alias("embedding"))

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"id": frame["id"].to_numpy(), "signature": list(_packed_sides(frame["embedding"], planes))})

    return rows.mapInPandas(sign, f"id {rows.schema['id'].dataType.simpleString()}, signature array<long>")


def _least_differing(asked: np.ndarray, ids: np.ndarray, words: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the ``limit`` signatures with fewest differing bits, smaller ids first, and the bits."""
    # Counted without a sign: numpy counts the bits of a negative number's absolute value.
    differing = np.bitwise_count((words ^ asked).view(np.uint64)).sum(axis=1, dtype=np.int64)
    best = _best(-differing, ids, limit)
    return best, differing[best]


def _scan(signed: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """(query_id, doc_id, differing): per task the best of each query; so many rows per query and task are shuffled.

    Few queries travel to every task. More of them meet the signatures in blocks, as in the exact search.
    """
    q_kind, d_kind = asked.schema["id"].dataType.simpleString(), signed.schema["id"].dataType.simpleString()
    schema = f"query_id {q_kind}, doc_id {d_kind}, differing long"

    def best_of(query_ids, query_words, frame: pd.DataFrame) -> pd.DataFrame:
        ids, words = frame["id"].to_numpy(), np.stack(frame["signature"])
        parts = []
        for query, own in zip(query_ids, query_words):
            best, differing = _least_differing(own, ids, words, limit)
            parts.append(pd.DataFrame({"query_id": query, "doc_id": ids[best], "differing": differing}))
        return pd.concat(parts)

    def cut(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["query_id", "differing", "doc_id"]).groupby("query_id").head(limit)

    if is_small(asked, _QUERIES_PER_BLOCK):
        rows = asked.toPandas()
        if not len(rows):
            return signed.sparkSession.createDataFrame([], schema)
        ids, words = rows["id"].to_numpy(), np.stack(rows["signature"])

        def few(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = None
            for frame in frames:
                if len(frame):
                    found = best_of(ids, words, frame)
                    kept = cut(found if kept is None else pd.concat([kept, found]))
            if kept is not None:
                yield kept

        return signed.mapInPandas(few, schema)

    def many(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "doc_id": [], "differing": []})
        return best_of(queries["id"].to_numpy(), np.stack(queries["signature"]), vectors)

    left, right = _blocks(signed, "id", asked, "id")
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(many, schema)


def candidate_neighbours(vectors: DataFrame, queries: DataFrame, k: int, dimensions: int, id_column: str = "doc_id",
                         embedding: str = "embedding", candidates: int | None = None,
                         signed: DataFrame | None = None, **planes) -> DataFrame:
    """(query_id, doc_id, cosine, score, rank) among the ``candidates`` vectors whose signatures differ least.

    The number of exact comparisons per query doesn't grow with the corpus. What grows is a scan of the signatures
    (``signed``, if stored), of which each task passes on its best only.
    """
    limit = candidates or candidate_count(k)
    asked = queries.select("query_id", F.col("embedding").alias("query_vector"))
    small = is_small(asked, _QUERIES_PER_BLOCK)
    wanted = signatures(queries, "query_id", "embedding", dimensions, **planes)
    if signed is None:
        signed = signatures(vectors, id_column, embedding, dimensions, **planes)
    found = _scan(signed, wanted, limit)
    chosen = top_k(found, limit, [F.asc("differing"), F.asc("doc_id")]).select("query_id", "doc_id")
    pairs = vectors.select(F.col(id_column).alias("doc_id"), F.col(embedding).alias("embedding")).join(
        hinted(chosen.join(hinted(asked, small), "query_id"), small), "doc_id"
    )
    near = pairs.select("query_id", "doc_id", F.round(cosine(F.col("embedding"), F.col("query_vector")), SCORE_DIGITS).alias("cosine"))
    best = top_k(near, k, [F.desc("cosine"), F.asc("doc_id")])
    # Half of a number of six digits can end in a five; as a decimal it isn't below it.
    half = (1 + F.col("cosine").cast("decimal(10,6)")) / 2
    return best.withColumn("score", F.round(half, SCORE_DIGITS).cast("double"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found, per query."""
    hits = exact.select("query_id", "doc_id").join(
        found.select("query_id", "doc_id").withColumn("_hit", F.lit(1)), ["query_id", "doc_id"], "left"
    )
    return hits.groupBy("query_id").agg((F.count("_hit") / F.count(F.lit(1))).alias("recall"))
