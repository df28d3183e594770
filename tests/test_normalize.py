import gzip
import hashlib
import json
import random
from html import unescape
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from shelfsift.functions import coerce as C
from shelfsift.functions import display
from shelfsift.functions.normalize import normalize_products, normalize_reviews
from shelfsift.plans import load, prepare
from shelfsift.sources import jsonl
from shelfsift.sources.tables import TableStore
from tests.sample import RAW_PRODUCTS, RAW_REVIEWS, lines


def raw(spark, rows):
    data = [(json.dumps(r), i) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "value string, ord int")


def by_title(spark, rows):
    return {r["title"]: r for r in normalize_products(raw(spark, rows)).collect()}


def test_products(spark):
    got = by_title(spark, RAW_PRODUCTS)
    assert len(got) == 6
    p1 = got["Aurora Wireless Headphones"]
    assert (p1.product_id, p1.brand, p1.category, p1.price) == ("P1", "Aurora", "Headphones", 249.0)
    assert p1.features == "noise cancelling  bluetooth"
    assert p1.description == "Comfortable over-ear headphones noise cancelling  bluetooth"
    cable = got["Cable"]
    assert (cable.description, cable.category, cable.brand, cable.price) == ("Cable", "Accessories", "Wirely", 1299.5)
    assert (cable.rating, cable.average_rating) == (4.5, 4.5)
    keyboard = got["Keyboard"]
    assert (keyboard.features, keyboard.price, keyboard.rating, keyboard.rating_number) == ("p q", 0.0, 0.0, 1024)
    assert (got["Negative"].price, got["Negative"].category) == (-5.0, "M")
    assert (got["Negative text"].price, got["Negative text"].features) == (5.0, "deep er True 1 2.5")
    assert got["Aurora Wireless Headphones II"].price == 0.0


def test_reviews(spark):
    got = {r["user_id"] + r["title"]: r for r in normalize_reviews(raw(spark, RAW_REVIEWS)).collect()}
    assert len(got) == len(RAW_REVIEWS) - 1
    first = got["u1Fine"]
    assert first.review_id == hashlib.sha1(b"P1:u1:1700000000:").hexdigest()
    assert (first.verified_purchase, first.timestamp, first.helpful_vote) == (False, 1700000000, 3)
    alias = got["r3s"]
    assert (alias.product_id, alias.rating, alias.text, alias.timestamp) == ("P1", 4.0, "text 3", 126)
    assert (alias.helpful_vote, alias.verified_purchase) == (2, True)
    assert (got["u2Breaks"].timestamp, got["u2Breaks"].verified_purchase) == (None, True)
    good = got["anonymousGood"]
    assert (good.timestamp, good.verified_purchase) == (None, False)
    assert good.review_id == hashlib.sha1(b"P3:anonymous:-1:Types well").hexdigest()


@pytest.mark.parametrize("value, number", [
    ("from $1,299.50", 1299.5), ("-5", 5.0), ("none", 0.0), (None, 0.0), (-5, -5.0), (True, 1.0), (4.50, 4.5), ([7], 7.0),
])
def test_number(spark, value, number):
    row = spark.createDataFrame([(json.dumps({"v": value}),)], "value string").select(
        F.parse_json("value").alias("p"), F.from_json("value", "map<string,string>").alias("t")
    )
    assert row.select(C.parse_number(C.raw_field(F.col("p"), F.col("t"), "v"))).first()[0] == number


@pytest.mark.parametrize("value, truth", [
    (0, False), (0.0, False), ("", False), ([], False), ({}, False), (False, False), (None, False),
    (" ", True), ("0", True), (1, True), ([0], True), ({"a": None}, True), (True, True), ("\n", True),
])
def test_truth(spark, value, truth):
    row = spark.createDataFrame([(json.dumps({"v": value}),)], "value string").select(
        F.parse_json("value").alias("p"), F.from_json("value", "map<string,string>").alias("t")
    )
    assert row.select(C.truthy(C.raw_field(F.col("p"), F.col("t"), "v"))).first()[0] is truth


def joined(value):
    """Nested values joined level by level."""
    if value is None:
        return ""
    if isinstance(value, (list, dict)):
        return " ".join(joined(v) for v in (value.values() if isinstance(value, dict) else value))
    return str(value)


def test_nested_values_of_any_depth(spark):
    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(3) if depth else 2
        if kind == 0:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        if kind == 1:
            return {f'k{i}":[{rng.choice("ab")}': value(depth - 1) for i in range(rng.randrange(4))}
        return rng.choice([None, True, False, 0, -7, 12.5, "", "plain", 'quo"te', "back\\slash\\", "é\n\t漢", ', "x": [1', "\\\""])

    values = [[value(depth)] for depth in range(13) for _ in range(30)]
    chain = "leaf"
    for level in range(40):
        chain = [None, chain] if level % 2 else {"a": chain, "b": {}}
    values.append(chain)
    rows = [(i, json.dumps({"v": v}, ensure_ascii=bool(i % 2))) for i, v in enumerate(values)]
    raw_rows = spark.createDataFrame(rows, "i int, value string").select(
        "i", F.parse_json("value").alias("p"), F.from_json("value", "map<string,string>").alias("t"))
    got = raw_rows.select("i", C.as_text(C.raw_field(F.col("p"), F.col("t"), "v")).alias("text")).collect()
    assert {r.i: r.text for r in got} == {i: joined(v) for i, v in enumerate(values)}


def test_counts_beyond_an_int(spark):
    rows = [{"parent_asin": "P", "title": str(n), "rating_number": n} for n in (2**31, 5e9, 1e30, "7,000,000,000 ratings", -3)]
    assert {t: r.review_count for t, r in by_title(spark, rows).items()} == {
        str(2**31): 2**31, "5000000000.0": 5 * 10**9, "1e+30": None, "7,000,000,000 ratings": 7 * 10**9, "-3": -3}


def test_character_references(spark):
    named = [f"&{name}" for name in html5]
    numbers = [f"&#{n};" for n in [*range(0x180), 0x2019, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFF,
                                   0x110000, 10**30]]
    numbers += [f"&#x{n:X}" for n in (0, 0x80, 0xE9, 0x2019, 0x1F600, 0x110000, 16**20)] + ["&#;", "&#x;", "&#xg;", "&#0065 &#00;"]
    mixed = ["", "plain", "&", "a & b", "&amp;lt;", "&ampamp;", "&notit;", "&notin;", "&eacutex", "&bogus;", "a&lt;b&gt;c&quot;", "&&amp&", "&a" * 40]
    texts = named + numbers + mixed + [a + b for a, b in zip(named, reversed(named))] + ["x" * 50_000 + "&eacute;" * 5000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", display.unescape(F.col("t")).alias("t")).collect()
    assert [r.t for r in sorted(got)] == [unescape(t) for t in texts]


def write(tmp_path, name, content):
    path = tmp_path / name
    data = "\n".join(content).encode() + b"\n"
    path.write_bytes(gzip.compress(data) if name.endswith(".gz") else data)
    return str(path)


def test_scan_blank_gzip_and_malformed(spark, tmp_path):
    path = write(tmp_path, "p.jsonl.gz", lines(RAW_PRODUCTS, blank=True))
    assert jsonl.read_json_lines(spark, path).count() == len(RAW_PRODUCTS)
    # A limit counts raw lines, and every second one is blank.
    assert jsonl.read_json_lines(spark, path, limit=5).count() == 3
    bad = write(tmp_path, "bad.jsonl", ['{"parent_asin": "P1", "title": "t"}', "{oops"])
    with pytest.raises(Exception, match="(?i)malformed"):
        normalize_products(jsonl.read_json_lines(spark, bad)).collect()


def test_file_order_over_many_splits(spark, tmp_path):
    for part in range(3):
        write(tmp_path, f"f{part}.jsonl", [json.dumps({"parent_asin": f"{part}-{i:05d}", "title": "t"}) for i in range(2000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = normalize_products(jsonl.read_json_lines(spark, str(tmp_path)))
        taken = jsonl.first_in_file_order(rows, 3500)
        ids = sorted(r.product_id for r in taken.select("product_id").collect())
        assert ids == [f"0-{i:05d}" for i in range(2000)] + [f"1-{i:05d}" for i in range(1500)]
        assert jsonl.first_in_file_order(rows, 3).count() == 3
        assert prepare.accepted_products(jsonl.read_json_lines(spark, str(tmp_path)), 0).count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_limit_inside_one_packed_file(spark, tmp_path):
    write(tmp_path, "a.jsonl.gz", [json.dumps({"parent_asin": f"a{i:05d}", "title": "t"}) for i in range(6000)])
    write(tmp_path, "b.jsonl", [json.dumps({"parent_asin": f"b{i:05d}", "title": "t" if i % 2 else ""}) for i in range(100)])
    rows = normalize_products(jsonl.read_json_lines(spark, str(tmp_path)))
    for n in (1, 4321, 6000, 6020, 9000):
        ids = sorted(r.product_id for r in jsonl.first_in_file_order(rows, n).select("product_id").collect())
        assert ids == ([f"a{i:05d}" for i in range(6000)] + [f"b{i:05d}" for i in range(1, 100, 2)])[:n]
    assert jsonl.read_json_lines(spark, str(tmp_path), 6010).count() == 6010


def test_prepare_and_load(spark, tmp_path):
    products = write(tmp_path, "products.jsonl", lines(RAW_PRODUCTS, blank=True))
    reviews = write(tmp_path, "reviews.jsonl.gz", lines(RAW_REVIEWS))
    out = str(tmp_path / "processed")
    counts = prepare.run(spark, products, reviews, out, None, 5)
    assert counts == {"product_count": 6, "review_count": 7}
    manifest = spark.read.json(f"{out}/manifest").first()
    assert (manifest["product_count"], manifest["max_reviews_per_product"], manifest["version"]) == (6, 5, 1)
    counted = spark.read.json(f"{out}/counters").first()
    assert (counted.scanned, counted.accepted, counted.skipped_per_product_cap) == (11, 7, 2)
    stored = {r.title: r for r in spark.read.json(f"{out}/products").collect()}
    p1 = stored["Aurora Wireless Headphones"]
    # Five kept in input order, the empty text uses up a review but no text.
    assert (p1.loaded_review_count, p1.review_text, p1.helpful_votes) == (5, "text 0 text 1 text 2 text 3", 11)
    assert p1.avg_review_rating == 3.0
    assert stored["Negative"].review_text == "" and stored["Negative"].loaded_review_count == 0
    enriched = {r.title: r for r in spark.read.json(f"{out}/reviews").collect()}
    assert enriched["Breaks"].brand == "Wirely"
    assert enriched["Fine"].product_title == "Aurora Wireless Headphones II"

    store = str(tmp_path / "store")
    first = load.run(spark, out, store, embeddings=False)
    again = load.run(spark, out, store, embeddings=True)
    for name, frame in first.items():
        assert frame.count() == again[name].count()
    assert again["products"].count() == 5
    row = again["products"].filter("product_id = 'P1'").first()
    assert row.title == "Aurora Wireless Headphones II"
    assert "title_suggest" not in again["product_documents"].columns
    # Searching the written postings gives what searching the tables gives.
    from shelfsift.plans import search

    tables = TableStore(spark, store)
    docs, texts = tables.read("product_documents"), tables.read("review_documents")
    kept = load.stored_index(tables, docs, texts)
    queries = spark.createDataFrame([(1, "wireles headphnes"), (2, "keyboard"), (3, "cabel"), (4, "types wel breaks")], "query_id int, q string")
    for dialect in search.DIALECTS:
        flows = [(search.product_scenario, (docs,))]
        flows += [(search.basic_product_search, (docs,))] if dialect == "lucene" else []
        flows += [(search.review_scenario, (texts, docs))] if dialect == "ladder" else []
        for flow, tables_of in flows:
            key = "review_id" if flow is search.review_scenario else "product_id"
            live = flow(*tables_of, queries, dialect).hits.select("query_id", key, "score").collect()
            read = flow(*tables_of, queries, dialect, stored=kept).hits.select("query_id", key, "score").collect()
            assert sorted(live) == sorted(read) and (live or dialect == "weighted" or key == "review_id")
    vectors = tables.read("product_vectors").first()
    assert len(vectors.embedding) == 768 and abs(sum(x * x for x in vectors.embedding) - 1) < 1e-4


def test_missing_review_source(spark, tmp_path):
    products = write(tmp_path, "products.jsonl", lines(RAW_PRODUCTS))
    counts = prepare.run(spark, products, str(tmp_path / "nothing.jsonl"), str(tmp_path / "out"))
    assert counts == {"product_count": 6, "review_count": 0}
    assert jsonl.first_existing(spark, [str(tmp_path / "nothing"), products, "x"]) == products


def test_processed_files_keep_unicode(spark, tmp_path):
    df = spark.createDataFrame([("ü – 漢", None)], "a string, b string")
    assert jsonl.write_json_lines(df, str(tmp_path / "u")) == 1
    assert jsonl.read_processed(spark, str(tmp_path / "u"), df.schema).collect() == df.collect()
    text = "".join(part.read_text() for part in (tmp_path / "u").glob("*.json"))
    assert "漢" in text and '"b":null' in text
