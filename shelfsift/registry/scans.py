"""Sources, sinks and keyed tables (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfsift import schemas
from shelfsift.operators.limits import first_n
from shelfsift.registry import register
from shelfsift.session import scratch_path
from shelfsift.sources import jsonl, tables, views
from shelfsift.sources.views import PRODUCTS_SQL, table


@register("a01_json_lines_scan", """
    SELECT 'f' || CAST(p_partkey % 3 AS VARCHAR) AS part_file, count(*) AS n,
           CAST(sum(p_partkey) AS BIGINT) AS key_sum, min(p_name) AS first_name
    FROM part GROUP BY 1""")
def json_lines_scan(spark, folder):
    """Parts written as gzipped JSON lines with blank lines between, read back as raw lines."""
    path = scratch_path(spark, "parts-jsonl")
    rows = table(spark, folder, "part").withColumn(
        "part_file", F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string"))
    )
    line = F.to_json(F.struct("p_partkey", "p_name", "part_file"))
    rows.select(F.explode(F.array(line, F.lit("   "))).alias("value")).write.option("compression", "gzip").text(path)
    value = F.parse_json("value")
    return jsonl.read_json_lines(spark, path).select(
        F.variant_get(value, "$.part_file", "string").alias("part_file"),
        F.variant_get(value, "$.p_partkey", "long").alias("key"),
        F.variant_get(value, "$.p_name", "string").alias("name"),
    ).groupBy("part_file").agg(
        F.count(F.lit(1)).alias("n"), F.sum("key").alias("key_sum"), F.min("name").alias("first_name")
    )


@register("a02_raw_line_limit", """
    SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id LIMIT 5000)
    WHERE event_type <> 'click'""")
def raw_line_limit(spark, folder):
    """The limit counts raw rows; the validity test comes after it."""
    events = table(spark, folder, "events").select("event_id", "event_type")
    return first_n(events, 5000, "event_id").filter(F.col("event_type") != "click")


@register("a03_first_existing_source", "SELECT count(*) AS n, min(r_name) AS first_name FROM region")
def first_existing_source(spark, folder):
    """The first candidate that exists is read."""
    path = jsonl.first_existing(spark, [f"{folder}/no_such_table.parquet", f"{folder}/region.parquet"])
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.min("r_name").alias("first_name"))


_ROUND_TRIP = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@register("a04_json_lines_sink", """
    SELECT count(*) AS written, (SELECT count(*) FROM customer) AS read_back FROM customer""")
def json_lines_sink(spark, folder):
    """The writer's row count next to what is read back."""
    path = scratch_path(spark, "customer-jsonl")
    customers = table(spark, folder, "customer")
    written = jsonl.write_json_lines(customers, path)
    return jsonl.read_processed(spark, path, customers.schema).agg(F.count(F.lit(1)).alias("read_back")).select(
        F.lit(written).cast("long").alias("written"), "read_back"
    )


@register("a05_processed_table_scan", _ROUND_TRIP)
def processed_table_scan(spark, folder):
    """JSON lines round trip with a given schema."""
    path = scratch_path(spark, "customer-processed")
    customers = table(spark, folder, "customer")
    jsonl.write_json_lines(customers, path)
    return jsonl.read_processed(spark, path, customers.schema)


@register("a06_load_manifest", """
    SELECT CAST(1 AS INT) AS version, CAST(100000 AS INT) AS product_limit,
           CAST(5 AS INT) AS max_reviews_per_product, 'part' AS product_source,
           (SELECT count(*) FROM part) AS product_count, (SELECT count(*) FROM documents) AS review_count""")
def load_manifest(spark, folder):
    return tables.manifest(
        table(spark, folder, "part"), table(spark, folder, "documents"),
        product_limit=100_000, max_reviews_per_product=5, product_source="part",
    )


@register("a07_upsert_last_wins", """
    WITH incoming AS (
      SELECT p_partkey, p_name || ' v' || CAST(v AS VARCHAR) AS p_name, p_brand, p_retailprice + v AS p_retailprice, v AS ord
      FROM (SELECT *, p_partkey + 100 * (p_size % 2) AS k FROM part) t, (SELECT unnest([1, 2]) AS v) s
      WHERE p_size < 20),
    latest AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY ord DESC) = 1)
    SELECT p_partkey, p_name, p_brand, p_retailprice FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM latest)
    UNION ALL SELECT p_partkey, p_name, p_brand, p_retailprice FROM latest""")
def upsert_last_wins(spark, folder):
    """Two changed versions of every small part are merged into the part table."""
    target = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_retailprice")
    changed = table(spark, folder, "part").filter("p_size < 20").select(
        "p_partkey", "p_name", "p_brand", "p_retailprice", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord")
    )
    incoming = changed.withColumn(
        "p_name", F.concat("p_name", F.lit(" v"), F.col("ord").cast("string"))
    ).withColumn("p_retailprice", F.col("p_retailprice") + F.col("ord"))
    return tables.upsert(target, incoming, "p_partkey", "ord")


@register("a08_insert_first_wins", """
    WITH incoming AS (
      SELECT c_custkey + shift AS c_custkey, c_name || '/' || CAST(shift AS VARCHAR) AS c_name, shift AS ord
      FROM customer, (SELECT unnest([50, 51, 52]) AS shift) s),
    first_in AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY ord) = 1)
    SELECT c_custkey, c_name FROM customer
    UNION ALL SELECT c_custkey, c_name FROM first_in WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)""")
def insert_first_wins(spark, folder):
    """Shifted copies of the customers: only the keys past the end are new."""
    target = table(spark, folder, "customer").select("c_custkey", "c_name")
    shifted = target.withColumn("ord", F.explode(F.array(F.lit(50), F.lit(51), F.lit(52))))
    incoming = shifted.select(
        (F.col("c_custkey") + F.col("ord")).alias("c_custkey"),
        F.concat("c_name", F.lit("/"), F.col("ord").cast("string")).alias("c_name"), "ord",
    )
    return tables.insert_if_absent(target, incoming, "c_custkey", "ord")


@register("a09_reset_reload", """
    SELECT n_nationkey, n_name, n_regionkey FROM nation""")
def reset_reload(spark, folder):
    """A table loaded twice; the second load resets it, so nothing of the first stays."""
    store = tables.TableStore(spark, scratch_path(spark, "store"))
    rows = table(spark, folder, "nation").withColumn("ord", F.col("n_nationkey"))
    store.load("nation", rows.withColumn("n_nationkey", F.col("n_nationkey") + 1000), "n_nationkey", "ord")
    return store.load("nation", rows, "n_nationkey", "ord", reset=True)


@register("a10_schema_defaults", """
    SELECT CAST(d.doc_id AS VARCHAR) AS review_id, CAST(d.doc_id % 150 AS VARCHAR) AS product_id,
           coalesce(CASE WHEN d.doc_id % 3 > 0 THEN d.source END, 'anonymous') AS user_id,
           coalesce(CAST(l.quality AS DOUBLE), 0.0) AS rating, '' AS title, d.text AS text,
           coalesce(l.toxic, 0) AS helpful_vote, false AS verified_purchase, CAST(NULL AS BIGINT) AS timestamp
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def schema_defaults(spark, folder):
    """Documents with sparse labels cast to the review schema, defaults filled in."""
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("review_id"), (F.col("doc_id") % 150).alias("product_id"),
        F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("user_id"),
        F.col("quality").alias("rating"), "text", F.col("toxic").alias("helpful_vote"),
    )
    return schemas.conform(rows, schemas.REVIEW_SCHEMA, schemas.REVIEW_DEFAULTS)


@register("a11_store_projection", f"""
    WITH {PRODUCTS_SQL}
    SELECT product_id, title, features, description, category, brand, price, rating, review_count FROM v_products""")
def store_projection(spark, folder):
    """Helper columns dropped for the document store."""
    full = views.products(spark, folder).withColumn("title_suggest", F.col("title")).withColumn(
        "semantic_text", F.col("description")
    )
    return schemas.document_store_projection(full)


@register("a12_row_cap", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 2500""")
def row_cap(spark, folder):
    """Trial load of the first rows in key order."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return tables.capped(orders, orders, 2500, "o_orderkey")[0]
