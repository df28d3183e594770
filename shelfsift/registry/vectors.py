"""Vectors and semantic search (F13-F16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsift.functions.normalize import embedding_text
from shelfsift.operators import vectors as V
from shelfsift.plans import semantic
from shelfsift.registry import corpora as C
from shelfsift.registry import matching as M
from shelfsift.registry import register
from shelfsift.sources import views
from shelfsift.sources.views import PRODUCTS_SQL, table

_SIZE = 64
_DIMS = 768


def _centroids(spark, folder):
    """The mean vector of every label as its query."""
    parts = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg("x").alias("x"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return means.groupBy(F.col("label").alias("query_id")).agg(ordered.alias("embedding"))


@register("f13_nearest_exact", """
    WITH parts AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings),
    means AS (SELECT label, i, avg(x) AS x FROM parts GROUP BY 1, 2),
    queries AS (SELECT label AS query_id, list(x ORDER BY i) AS q FROM means GROUP BY 1),
    pairs AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS c FROM embeddings, queries)
    SELECT query_id, doc_id, round(c, 4) AS cosine, round((1 + c) / 2, 4) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) AS rank
    FROM pairs QUALIFY rank <= 10""")
def nearest_exact(spark, folder):
    """The ten vectors nearest to the mean of every label."""
    found = V.exact_neighbours(table(spark, folder, "embeddings"), _centroids(spark, folder), 10, "vec_id")
    return found.select(
        "query_id", "doc_id", F.round("cosine", 4).alias("cosine"), F.round((1 + F.col("cosine")) / 2, 4).alias("score"),
        F.col("rank").cast("long").alias("rank"),
    )


def candidates_sql(vectors: str, queries: str, dimensions: int, k: int = 10) -> str:
    """CTE ``near`` (query_id, doc_id, c) of ``vectors`` (doc_id, v) and ``queries`` (query_id, q): doubles in lists."""
    signs = f"CASE WHEN substring(md5('7:' || p || ':' || d), 1, 1) < '8' THEN 1.0 ELSE -1.0 END"
    side = lambda v: f"CASE WHEN list_dot_product({v}, w) / sqrt(list_dot_product({v}, {v})) > 1e-6 THEN '1' ELSE '0' END"
    return f"""planes AS (SELECT p, list({signs} ORDER BY d)::DOUBLE[] AS w FROM range({V.BITS}) a(p), range({dimensions}) b(d) GROUP BY 1),
    v_sides AS (SELECT doc_id, CAST(string_agg({side('v')}, '' ORDER BY p) AS BIT) AS s FROM {vectors}, planes GROUP BY 1),
    q_sides AS (SELECT query_id, CAST(string_agg({side('q')}, '' ORDER BY p) AS BIT) AS s FROM {queries}, planes GROUP BY 1),
    differing AS (SELECT q.query_id, v.doc_id, bit_count(xor(q.s, v.s)) AS n FROM q_sides q, v_sides v),
    chosen AS (SELECT * FROM differing QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n, doc_id) <= {V.candidate_count(k)}),
    near AS (SELECT c.query_id, c.doc_id, round(list_cosine_similarity(v.v, q.q), 6) AS c FROM chosen c
             JOIN {vectors} v ON v.doc_id = c.doc_id JOIN {queries} q ON q.query_id = c.query_id
             QUALIFY row_number() OVER (PARTITION BY c.query_id ORDER BY round(list_cosine_similarity(v.v, q.q), 6) DESC, c.doc_id) <= {k})"""


_CENTROID_SQL = f"""parts AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings),
    means AS (SELECT label, i, avg(x) AS x FROM parts GROUP BY 1, 2),
    queries AS (SELECT label AS query_id, list(x ORDER BY i)::DOUBLE[] AS q FROM means GROUP BY 1),
    vectors AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    {candidates_sql('vectors', 'queries', _SIZE)}"""


@register("f14_nearest_candidates", f"""
    WITH {_CENTROID_SQL}
    SELECT query_id, doc_id, round(c, 4) AS cosine, round((1 + c) / 2, 4) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) AS rank FROM near""")
def nearest_candidates(spark, folder):
    """The same among the hundred vectors whose signatures differ least."""
    found = V.candidate_neighbours(table(spark, folder, "embeddings"), _centroids(spark, folder), 10, _SIZE, "vec_id")
    return found.select(
        "query_id", "doc_id", F.round("cosine", 4).alias("cosine"), F.round((1 + F.col("cosine")) / 2, 4).alias("score"),
        F.col("rank").cast("long").alias("rank"),
    )


@register("f14_candidate_recall", f"""
    WITH {_CENTROID_SQL},
    exact AS (SELECT query_id, doc_id FROM queries, vectors
              QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(v, q), 6) DESC, doc_id) <= 10)
    SELECT e.query_id, count(n.doc_id) / CAST(count(*) AS DOUBLE) AS recall FROM exact e
    LEFT JOIN near n ON n.query_id = e.query_id AND n.doc_id = e.doc_id GROUP BY 1""")
def candidate_recall(spark, folder):
    """Share of the exact neighbours that the candidates contain."""
    rows, queries = table(spark, folder, "embeddings"), _centroids(spark, folder)
    near = V.candidate_neighbours(rows, queries, 10, _SIZE, "vec_id")
    return V.recall(near, V.exact_neighbours(rows, queries, 10, "vec_id"))


def hashed_sql(name: str, source: str, id_column: str, text: str, dimensions: int = _DIMS) -> str:
    return f"""{name}_words AS (SELECT {id_column} AS doc_id, md5(unnest({C.tokens_sql(text)})) AS h FROM {source}),
    {name}_sums AS (
      SELECT doc_id, CAST(CAST('0x' || substring(h, 1, 8) AS BIGINT) % {dimensions} AS INT) AS dim,
             sum(CASE WHEN substring(h, 9, 1) < '8' THEN 1.0 ELSE -1.0 END)::DOUBLE AS s FROM {name}_words GROUP BY 1, 2 HAVING s <> 0),
    {name} AS (SELECT doc_id, dim, s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)) AS weight FROM {name}_sums)"""


def dense_sql(name: str, sparse: str, as_id: str, as_vector: str, dimensions: int) -> str:
    """CTE ``name`` of whole vectors, rounded as stored floats are."""
    return f"""{name} AS (SELECT i.doc_id AS {as_id}, list(CAST(CAST(coalesce(s.weight, 0) AS FLOAT) AS DOUBLE) ORDER BY d) AS {as_vector}
      FROM (SELECT DISTINCT doc_id FROM {sparse}) i CROSS JOIN range({dimensions}) r(d)
      LEFT JOIN {sparse} s ON s.doc_id = i.doc_id AND s.dim = d GROUP BY 1)"""


@register("f15_embed_texts", f"""
    WITH {PRODUCTS_SQL}, texts AS (SELECT product_id, title || ' ' || substring(features, 1, 200) || ' ' || substring(description, 1, 200) AS t FROM v_products),
    {hashed_sql('hashed', 'texts', 'product_id', 't')}
    SELECT doc_id, dim, round(weight, 6) AS weight FROM hashed""")
def embed_texts(spark, folder):
    """Hashed features of every product text, one row per dimension that is not zero."""
    p = views.products(spark, folder)
    texts = p.select("product_id", embedding_text(F.col("title"), F.col("features"), F.col("description")).alias("t"))
    rows = V.hashed_features(texts, "product_id", "t", _DIMS)
    return rows.withColumn("weight", F.round("weight", 6))


def _length_model(texts):
    """A stand-in model: character and word counts."""
    return [[float(len(t)), float(len(t.split()))] for t in texts]


@register("f15_embed_with_model", f"""
    WITH {PRODUCTS_SQL} SELECT product_id AS doc_id, CAST(length(description) AS DOUBLE) AS x,
           CAST(len(string_split(description, ' ')) AS DOUBLE) AS y FROM v_products""")
def embed_with_model(spark, folder):
    """Every product description through a model, 100 texts per call."""
    rows = V.embed_column(views.products(spark, folder), "product_id", "description", _length_model)
    return rows.select(
        "doc_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y")
    )


_SEMANTIC = [(1, "red widget"), (2, "small ring economy"), (3, "standard hot gear thing")]


@register("f16_semantic_and_keyword", f"""
    WITH {C.queries_sql(_SEMANTIC)}, {C.PRODUCT_POSTINGS_SQL}, {C.query_terms_sql(C.PRODUCT_FIELDS_SQL)}, {C.bm25_sql()},
    {hashed_sql('docs', 'v_products', 'product_id', 'description')}, {hashed_sql('asked', 'queries', 'query_id', 'q')},
    near AS (SELECT a.doc_id AS query_id, d.doc_id, round(sum(a.weight * d.weight), 6) AS c FROM asked a JOIN docs d ON d.dim = a.dim GROUP BY 1, 2
             QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, d.doc_id) <= 10),
    scored AS (SELECT query_id, doc_id, round(max(score * {C.boost_sql(C.PRODUCT_BOOSTS)}), 6) AS score FROM field_scores
               WHERE matched >= CASE WHEN n_terms <= 2 THEN n_terms ELSE floor(round(n_terms * 0.7, 9)) END GROUP BY 1, 2)
    SELECT 'semantic' AS section, query_id, doc_id, round((1 + c) / 2, 4) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM near
    UNION ALL SELECT 'keyword', query_id, doc_id, round(score, 4), rank, total FROM ({M._page_sql('scored')})""")
def semantic_and_keyword(spark, folder):
    """Nearest hashed vectors next to keyword matches with enough words."""
    products = views.products(spark, folder)
    embedded = V.dense(V.hashed_features(products, "product_id", "description", _DIMS), _DIMS)
    rows = semantic.semantic_and_keyword(
        C.product_index(spark, folder), embedded, C.query_table(spark, _SEMANTIC), C.PRODUCT_BOOSTS, 10, _DIMS
    )
    return rows.withColumn("score", F.round("score", 4)).withColumn("rank", F.col("rank").cast("long"))
