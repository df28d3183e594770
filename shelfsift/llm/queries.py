"""The dealt operators as queries on the test tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsift.llm import exact_dedup as exact
from shelfsift.llm import conversation_repair as repairs
from shelfsift.llm import fill_middle, html_text, license_scan, merkle, mixing, packing, secret_scan, simhash
from shelfsift.llm import substring_dedup, token_files, toxicity
from shelfsift.llm.common import located
from shelfsift.session import scratch_path

#: Vocabulary of the packed ids.
TOKENIZER = "word_bpe_49k.json"

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return keep


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@register("op1_simhash")
def op1_simhash(spark, folder):
    """Fingerprint and component of every document; the component is named by its smallest doc_id."""
    found = simhash.near_dedup(documents(spark, folder), ["doc_id"])
    return found.select(
        "doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


@register("op3_merkle")
def op3_merkle(spark, folder):
    """Fingerprints of every text and of its edited text, and how alike they are."""
    return merkle.fingerprints(documents(spark, folder))


@register("op5_mixing", r"""
    WITH sized AS (
      SELECT doc_id, source, md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM sized GROUP BY source),
    seen AS (SELECT *, 3 * source_size / w AS level, sum(source_size) OVER () AS total, sum(w) OVER () AS weights FROM src),
    steps AS (SELECT *, total - coalesce(sum(3 * source_size) OVER before, 0) AS rest,
                     weights - coalesce(sum(w) OVER before, 0) AS share
              FROM seen WINDOW before AS (ORDER BY level, w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    marked AS (SELECT *, level < rest / share AS clamped FROM steps),
    final AS (SELECT max(total) - coalesce(sum(3 * source_size) FILTER (clamped), 0) AS rest,
                     sum(w) FILTER (NOT clamped) AS share FROM marked),
    target AS (SELECT m.source, m.source_size,
                 CASE WHEN clamped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(w * f.rest AS DOUBLE) / CAST(f.share AS DOUBLE) END AS target
               FROM marked m, final f),
    placed AS (SELECT s.doc_id, s.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS goal,
                 coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY h, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
               FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source),
    whole AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS repeats FROM placed)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(size * repeats + greatest(0, least(size, goal - repeats * source_size - earlier)) AS BIGINT) AS taken
    FROM whole""")
def op5_mixing(spark, folder):
    """Words that the mix takes of every document."""
    found = mixing.mix(documents(spark, folder).select("doc_id", "text", "source"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


@register("op8_exact_dedup", """
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
               FROM documents)
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
    FROM n WINDOW same AS (PARTITION BY t)""")
def op8_exact_dedup(spark, folder):
    """Which row stays of equal texts, for every document."""
    found = exact.exact_dedup(documents(spark, folder))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@register("op10_packing")
def op10_packing(spark, folder):
    """Where every piece of every document stands in the packed sequences."""
    import public_tokenizers

    pieces = packing.pack(documents(spark, folder), ["doc_id"], public_tokenizers.path(TOKENIZER))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@register("op2_html_text")
def op2_html_text(spark, folder):
    """Main text of every page."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html")
    found = html_text.extract(pages, ["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op4_toxicity")
def op4_toxicity(spark, folder):
    """Expected severity of every document, and whether it is toxic."""
    docs = documents(spark, folder).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = docs.select("doc_id", toxicity.severity(model, F.col("text")).alias("s")).select("doc_id", "s.*")
    return scored.select(
        "doc_id", F.col("expected").alias("expected_severity"), "toxic_probability", "grade",
        (F.col("toxic_probability") >= 0.5).alias("toxic"))


@register("op7_license_scan")
def op7_license_scan(spark, folder):
    """License phrases and notices in every document."""
    return license_scan.scan(documents(spark, folder)).drop("spans")


@register("op9_secret_scan")
def op9_secret_scan(spark, folder):
    """Secrets in every document, by fixed patterns and by character models."""
    docs = documents(spark, folder).select("doc_id", "text")
    found = secret_scan.scan(docs, secret_scan.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@register("op6_substring_dedup")
def op6_substring_dedup(spark, folder):
    """Passages that repeat across documents, and the class of every document."""
    return substring_dedup.substring_dedup(documents(spark, folder))


@register("op13_fill_middle", r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                 regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok
               FROM documents),
    d AS (SELECT *, CAST(len(tok) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
            CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3,
            CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
    f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                           OR h3 % 100 >= 50 THEN 'plain'
                         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
            least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM d),
    c AS (SELECT *, array_to_string(tok[1:a], '') AS pre, array_to_string(tok[a + 1:b], '') AS mid,
            array_to_string(tok[b + 1:], '') AS suf FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                  ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM c""")
def op13_fill_middle(spark, folder):
    """How every document is set out for fill-in-middle, and its text rebuilt from that."""
    found = fill_middle.rearrange(documents(spark, folder).select("doc_id", "text"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(text, 256).alias("restored_sha256"))


@register("op12_token_files")
def op12_token_files(spark, folder):
    """Ids of every document, written to files of coded blocks and read back from them."""
    import public_tokenizers

    target = scratch_path(spark, "token-files")
    token_files.write(documents(spark, folder).select("doc_id", "text"), public_tokenizers.path(TOKENIZER), target)
    found = token_files.read(spark, target)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with some rows dropped, emptied, cut short, repeated or given another role, as their keys fall."""
    rows = located(rows)
    name, turn, role, text = (
        F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = (F.crc32(F.concat(name, F.lit(":"), turn)) % 20).alias("kind")
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "__file", "__row", kind)
    one = F.lit(0)
    return rows.filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        "__file", "__row", F.explode(F.when(F.col("kind") == 3, F.array(one, one)).otherwise(F.array(one))).alias("copy"),
    ).drop("copy")


@register("op11_conversation_repair")
def op11_conversation_repair(spark, folder):
    """Faults of every damaged conversation, its cheapest edits and the digest of what they make of it."""
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    found = repairs.repair(damaged(rows))
    digests = repairs.digests(found).withColumnRenamed("conv", "named")
    every = rows.select("conv_id").distinct()
    every = every.join(found.conversations, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    every = every.join(digests, F.col("conv_id").eqNullSafe(F.col("named")), "left")
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.select(
        "conv_id", *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in figures),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
