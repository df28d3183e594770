"""One product and one word in a large share of all rows, with broadcasts off and skew handling on."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shelfsift.operators import enrich, facets, limits, match, postings, review_stats

N = 6000


@pytest.fixture(scope="module")
def rows(spark):
    hot = lambda i: "hot" if i % 5 < 2 else f"p{i % 97}"
    data = [(i, hot(i), float(1 + i % 5), f"common word{i % 50}" if i % 3 else "", i % 7) for i in range(N)]
    df = spark.createDataFrame(data, "ord long, product_id string, rating double, text string, helpful_vote int")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield data, df
    for key in settings:
        spark.conf.unset(key)


def test_cap_and_aggregates(rows):
    data, df = rows
    kept = defaultdict(list)
    for r in data:
        if len(kept[r[1]]) < 5:
            kept[r[1]].append(r[0])
    capped = enrich.cap_per_product(df, 5)
    assert sorted(r.ord for r in capped.collect()) == sorted(o for v in kept.values() for o in v)
    got = {r.product_id: r for r in review_stats.review_aggregates(df).collect()}
    for product in ("hot", "p5"):
        mine = [r for r in data if r[1] == product]
        assert got[product].loaded_review_count == len(mine)
        assert got[product].helpful_votes == sum(r[4] for r in mine)
        assert got[product].review_text == " ".join([r[3] for r in mine if r[3]][:5])


def test_join_keeps_every_row(spark, rows):
    data, df = rows
    products = spark.createDataFrame(
        [(p, p.upper(), "b", "c") for p in {r[1] for r in data}], "product_id string, title string, brand string, category string"
    )
    joined = enrich.join_products(df, products)
    assert joined.count() == N
    assert {r.value: r.n for r in facets.value_counts(joined, "product_title").collect()} == Counter(r[1].upper() for r in data)


def test_a_word_in_most_rows(spark, rows, monkeypatch):
    data, df = rows
    index = postings.TextIndex.of(df, [postings.IndexField("text")], "ord")
    queries = spark.createDataFrame([(1, "common"), (2, "common word7")], "query_id int, q string")
    terms = postings.query_terms(queries, index.fields)
    monkeypatch.setattr(match, "is_small", lambda df: False)
    scores = match.any_term_match(index, terms)
    totals = {r.query_id: r.total for r in limits.match_totals(scores).collect()}
    with_text = sum(1 for r in data if r[3])
    assert totals == {1: with_text, 2: with_text}
    best = limits.top_k(scores, 3, [F.desc("score"), F.asc("doc_id")]).filter("query_id = 2").orderBy("rank").collect()
    assert [r.doc_id for r in best] == [r[0] for r in data if r[3].endswith("word7")][:3]
    enough = match.best_field(match.minimum_match_scores(index, terms)).filter("query_id = 2")
    assert enough.count() == sum(1 for r in data if r[3].endswith("word7"))
