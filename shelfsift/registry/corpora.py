"""Corpora and query texts shared by the search queries, with their SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfsift.functions.text import (
    ACCENTED, ENGLISH_STOP_WORDS, LIGATURES, PLAIN, PLAIN_WORDS, PRODUCT, SEARCH_STOP_WORDS,
)
from shelfsift.operators.match import CLASS_WEIGHTS
from shelfsift.operators.postings import IndexField, TextIndex
from shelfsift.registry.stems import later_stems_sql
from shelfsift.sources import views
from shelfsift.sources.views import PRODUCTS_SQL, table

DOCUMENT_QUERIES = [(1, "with from"), (2, "this"), (3, "With THE fröm"), (4, "unheard of words")]
PRODUCT_QUERIES = [(1, "red widget"), (2, "hot gear"), (3, "economy small ring"), (4, "brand 17")]
MISSPELT_QUERIES = [(1, "widgte red"), (2, "smal rign"), (3, "econmy geer"), (4, "fluxcapacitor")]

DOCUMENT_FIELDS = [IndexField("text")]
PRODUCT_FIELDS = [
    IndexField("title"), IndexField("brand", analyzer=PLAIN_WORDS), IndexField("category", analyzer=PLAIN_WORDS),
    IndexField("features"), IndexField("description"),
]
PRODUCT_BOOSTS = {"title": 5, "brand": 3, "category": 2, "features": 3, "description": 2}


def query_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "query_id int, q string")


def queries_sql(rows: list[tuple], name: str = "queries") -> str:
    values = ", ".join(f"({i}, '{q}')" for i, q in rows)
    return f"{name} AS (SELECT * FROM (VALUES {values}) v(query_id, q))"


def document_index(spark: SparkSession, folder: str) -> TextIndex:
    return TextIndex.of(table(spark, folder, "documents"), DOCUMENT_FIELDS, "doc_id")


def product_index(spark: SparkSession, folder: str) -> TextIndex:
    return TextIndex.of(views.products(spark, folder), PRODUCT_FIELDS, "product_id")


def fold_sql(text: str) -> str:
    out = f"translate({text}, '{ACCENTED}', '{PLAIN}')"
    for ligature, letters in LIGATURES.items():
        out = f"replace({out}, '{ligature}', '{letters}')"
    return out


def tokens_sql(text: str, folded: bool = True) -> str:
    clean = fold_sql(f"lower({text})") if folded else f"lower({text})"
    return f"regexp_extract_all({clean}, '[\\p{{L}}\\p{{N}}]+')"


def field_tokens_sql(text: str, folded: bool | None) -> str:
    """Words of a field; None takes the whole value as its one word."""
    return f"[{text}]" if folded is None else tokens_sql(text, folded)


def postings_sql(source: str, id_column: str, fields: list[tuple[str, bool | None]], name: str = "posts") -> str:
    """(doc_id, field, field_no, term, pos, dl) and the field statistics as CTEs."""
    parts = " UNION ALL ".join(
        f"SELECT {id_column} AS doc_id, '{f}' AS field, {i} AS field_no, {field_tokens_sql(f, folded)} AS toks FROM {source}"
        for i, (f, folded) in enumerate(fields)
    )
    return f"""{name}_docs AS ({parts}),
    {name} AS (SELECT doc_id, field, field_no, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos, len(toks) AS dl FROM {name}_docs),
    {name}_stats AS (SELECT field, count(*) AS n_docs, avg(len(toks)) AS avg_dl FROM {name}_docs WHERE len(toks) > 0 GROUP BY 1)"""


DOCUMENT_POSTINGS_SQL = postings_sql("documents", "doc_id", [("text", True)])
PRODUCT_POSTINGS_SQL = PRODUCTS_SQL + ",\n    " + postings_sql(
    "v_products", "product_id",
    [("title", True), ("brand", False), ("category", False), ("features", True), ("description", True)],
)


def query_terms_sql(fields: list[tuple[str, bool | None]], queries: str = "queries", name: str = "qterms") -> str:
    parts = " UNION ALL ".join(
        f"SELECT query_id, '{f}' AS field, unnest({field_tokens_sql('q', folded)}) AS term, "
        f"generate_subscripts({field_tokens_sql('q', folded)}, 1) - 1 AS slot, len({field_tokens_sql('q', folded)}) AS n_terms FROM {queries}"
        for f, folded in fields
    )
    return f"{name} AS (SELECT *, CAST(1 AS DOUBLE) AS weight FROM ({parts}))"


PRODUCT_FIELDS_SQL = [("title", True), ("brand", False), ("category", False), ("features", True), ("description", True)]


def bm25_sql(terms: str = "qterms", posts: str = "posts") -> str:
    """Field scores as CTE ``field_scores`` (query_id, doc_id, field, score, matched, n_terms)."""
    return f"""tf AS (
      SELECT doc_id, field, term, dl, count(*) AS tf FROM {posts} WHERE (field, term) IN (SELECT (field, term) FROM {terms}) GROUP BY ALL),
    df AS (
      SELECT t.field, t.term, ln(1 + (any_value(s.n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf, any_value(s.avg_dl) AS avg_dl
      FROM tf t JOIN {posts}_stats s ON s.field = t.field GROUP BY 1, 2),
    impacts AS (
      SELECT t.doc_id, t.field, t.term, d.idf * t.tf / (t.tf + 1.2 * (1 - 0.75 + 0.75 * t.dl / d.avg_dl)) AS impact
      FROM tf t JOIN df d ON d.field = t.field AND d.term = t.term),
    slots AS (
      SELECT q.query_id, i.doc_id, q.field, q.slot, q.n_terms, max(i.impact * q.weight) AS score
      FROM impacts i JOIN {terms} q ON q.field = i.field AND q.term = i.term GROUP BY ALL),
    field_scores AS (SELECT query_id, doc_id, field, n_terms, sum(score) AS score, count(*) AS matched FROM slots GROUP BY ALL)"""


def boost_sql(boosts: dict[str, float]) -> str:
    cases = " ".join(f"WHEN '{f}' THEN {b}" for f, b in boosts.items())
    return f"CASE field {cases} ELSE 1 END"


STOP_SQL = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
SEARCH_STOP_SQL = ", ".join(f"'{w}'" for w in SEARCH_STOP_WORDS)

# Words of a query: (query_id, alternative, word, excluded).
AskedWord = tuple[int, int, str, bool]


def english_sql(source: str, id_column: str, classes: dict[str, str], asked: list[AskedWord], among: str = "TRUE") -> str:
    """The weighted dialect over English stems, for queries without phrases, as CTEs.

    ``chained``: (doc_id, term, word, pos, weight); ``units`` and ``groups``: the words of the queries; ``matched``:
    (query_id, doc_id); ``asked_hits``: postings of the words that rank; ``marks``: (query_id, terms). ``among`` is the
    filter on the source that a query which only excludes is answered from.
    """
    tokens = ", ".join(f"{tokens_sql(f, False)} AS t{i}" for i, f in enumerate(classes))
    last = lambda i: f"coalesce(list_max([i for i in range(1, len(t{i}) + 1) if t{i}[i] NOT IN ({SEARCH_STOP_SQL})]), 0)"
    parts = []
    for i, c in enumerate(classes.values()):
        before = " + ".join(["0", *(f"b{j}" for j in range(i))])
        parts.append(f"SELECT doc_id, unnest(t{i}) AS word, {before} + generate_subscripts(t{i}, 1) AS pos, "
                     f"CAST({CLASS_WEIGHTS[c]} AS DOUBLE) AS weight FROM e_last")
    rows = ", ".join(f"({q}, {g}, '{w}', {negated})" for q, g, w, negated in asked)
    return f"""e_tokens AS (SELECT {id_column} AS doc_id, {tokens} FROM {source}),
    e_last AS (SELECT *, {', '.join(f'{last(i)} AS b{i}' for i in range(len(classes)))} FROM e_tokens),
    e_kept AS (SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE word NOT IN ({SEARCH_STOP_SQL})),
    e_asked AS (SELECT * FROM (VALUES {rows}) v(query_id, grp, word, negated) WHERE word NOT IN ({SEARCH_STOP_SQL})),
    e_words AS (SELECT word AS term FROM e_kept UNION SELECT word FROM e_asked),
    {later_stems_sql('e_words', 'e_stems')},
    chained AS (SELECT k.doc_id, s.stem AS term, k.word, k.pos, k.weight FROM e_kept k JOIN e_stems s ON s.term = k.word),
    units AS (SELECT DISTINCT a.query_id, a.grp, s.stem AS term, a.negated FROM e_asked a JOIN e_stems s ON s.term = a.word),
    groups AS (SELECT query_id, grp, count(DISTINCT term) FILTER (NOT negated) AS n_terms FROM units GROUP BY 1, 2),
    seen AS (SELECT u.query_id, u.grp, c.doc_id, count(DISTINCT u.term) FILTER (NOT u.negated) AS hit, count(*) FILTER (u.negated) AS excluded
             FROM units u JOIN chained c ON c.term = u.term GROUP BY 1, 2, 3),
    matched AS (
      SELECT DISTINCT query_id, doc_id FROM (
        SELECT s.query_id, s.doc_id FROM seen s JOIN groups g ON g.query_id = s.query_id AND g.grp = s.grp
        WHERE g.n_terms > 0 AND s.hit = g.n_terms AND s.excluded = 0
        UNION ALL SELECT g.query_id, d.{id_column} FROM groups g, {source} d WHERE g.n_terms = 0 AND {among} AND NOT EXISTS (
          SELECT 1 FROM seen s WHERE s.query_id = g.query_id AND s.grp = g.grp AND s.doc_id = d.{id_column}))),
    marks AS (SELECT u.query_id, list(DISTINCT c.word) AS terms FROM units u JOIN (SELECT DISTINCT term, word FROM chained) c
              ON c.term = u.term WHERE NOT u.negated GROUP BY 1),
    asked_hits AS (SELECT u.query_id, u.grp, c.doc_id, c.term, c.pos, c.weight, g.n_terms FROM units u JOIN chained c ON c.term = u.term
                   JOIN groups g ON g.query_id = u.query_id AND g.grp = u.grp WHERE NOT u.negated)"""


FREQUENCY_SQL = """nth AS (SELECT *, row_number() OVER (PARTITION BY query_id, grp, doc_id, term ORDER BY weight DESC, pos) AS i FROM asked_hits),
    ranked AS (SELECT query_id, doc_id, round(max(s), 6) AS score FROM (
      SELECT query_id, grp, doc_id, sum(weight / (i * i)) / any_value(n_terms) AS s FROM nth GROUP BY 1, 2, 3) GROUP BY 1, 2)"""

COVER_SQL = """slots AS (SELECT *, dense_rank() OVER (PARTITION BY query_id, grp ORDER BY term) AS slot FROM asked_hits),
    last AS (SELECT query_id, grp, doc_id, pos, n_terms,
               max(CASE WHEN slot = 1 THEN {'p': pos, 'w': weight} END) OVER w AS a, max(CASE WHEN slot = 2 THEN {'p': pos, 'w': weight} END) OVER w AS b,
               max(CASE WHEN slot = 3 THEN {'p': pos, 'w': weight} END) OVER w AS c
             FROM slots WINDOW w AS (PARTITION BY query_id, grp, doc_id ORDER BY pos)),
    complete AS (SELECT query_id, grp, doc_id, least(a.p, b.p, c.p) AS s, pos AS e,
                   n_terms / (coalesce(1 / a.w, 0) + coalesce(1 / b.w, 0) + coalesce(1 / c.w, 0)) AS hm
                 FROM last WHERE (a.p IS NOT NULL)::INT + (b.p IS NOT NULL)::INT + (c.p IS NOT NULL)::INT = n_terms),
    spans AS (SELECT query_id, grp, doc_id, s, min(e) AS e, arg_min(hm, e) AS hm FROM complete GROUP BY 1, 2, 3, 4),
    covered AS (SELECT query_id, doc_id, round(max(s), 6) AS score FROM (
      SELECT query_id, grp, doc_id, sum(hm / (e - s + 1)) AS s FROM spans GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
