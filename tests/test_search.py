"""Search, ranking, facets and vectors on small catalogues and against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfsift.functions import filters
from shelfsift.functions.distance import edit_distance
from shelfsift.functions.stem import LATER_STEP_2, LATER_STEP_3, LATER_STEP_4, WHOLE_WORDS, later_stem, stem_word
from shelfsift.functions.text import ENGLISH_REVIEW, PRODUCT, word_trigrams
from shelfsift.operators import facets, fuzzy, highlight, limits, match, postings, rank, review_stats, trigram, vectors
from shelfsift.plans import analytics, search
from shelfsift.registry import matching
from shelfsift.registry.stems import later_stems_sql, stems_sql
from shelfsift.sources import tables, views
from tests.stem_examples import LATER_STEMS, LATER_WORDS, STEP_EXAMPLES

PRODUCTS = [
    ("B1", "Sony Wireless Noise Canceling Headphones", "Sony", "Headphones", 349.0, 4.6, 100),
    ("B2", "Bose Quiet Wireless Headphones", "Bose", "Headphones", 329.0, 4.7, 50),
    ("B3", "Wired Mouse", "Logi", "Mice", 50.0, 4.0, 10),
    ("B4", "Wireless Mouse", "Logi", "Mice", 100.0, 4.0, 20),
    ("B5", "Battery Pack", "Anker", "Power", 300.0, 3.0, 5),
    ("B6", "Cheap Cable", "Noname", "Cables", 0.0, 0.0, 0),
]
REVIEWS = [
    ("R1", "B1", 2.0, "Good sound but battery issue", "The battery dies after a week, a real problem.", 146),
    ("R2", "B1", 5.0, "Excellent", "Great quality on flights.", 42),
    ("R3", "B5", 1.0, "Battery problem", "The battery's problem is the battery.", 33),
    ("R4", "B3", 1.0, "Broke", "Button problem.", 5),
    ("R5", "B2", 4.0, "Battery fine", "No battery problem at all.", 7),
]


@pytest.fixture(scope="module")
def catalogue(spark):
    p = spark.createDataFrame(PRODUCTS, "product_id string, title string, brand string, category string, price double, rating double, review_count int")
    p = p.withColumn("features", F.lit("")).withColumn("description", F.col("title"))
    r = spark.createDataFrame(REVIEWS, "review_id string, product_id string, rating double, title string, text string, helpful_vote int")
    return p, r


def ask(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "query_id int, q string")


def test_misspelt_demo_query_finds_the_product(spark, catalogue):
    queries = ask(spark, "wireles noise canclling headphnes sony")
    for dialect in ("lucene", "ladder"):
        hits = search.product_scenario(catalogue[0], queries, dialect).hits.orderBy("rank").collect()
        assert hits[0].product_id == "B1", dialect
        assert "<em>" in hits[0].highlights["title"][0]
    # The weighted dialect has no typo tolerance here.
    assert search.product_scenario(catalogue[0], queries, "weighted").hits.count() == 0


def test_battery_problem_and_or(spark, catalogue):
    products, reviews = catalogue
    queries = ask(spark, "battery problem")
    both = analytics.review_analytics(reviews, products, queries, "weighted", PRODUCT).summary.first()
    assert (both.matched_negative_reviews, both.avg_rating) == (2, 1.5)
    either = analytics.review_analytics(reviews, products, queries, "lucene", PRODUCT).summary.first()
    assert (either.n, either.avg_rating) == (3, 1.33)
    brands = analytics.review_analytics(reviews, products, queries, "weighted", PRODUCT).brands.collect()
    assert {b.value: (b.negative_review_count, b.avg_rating, b.total_helpful_votes) for b in brands} == {
        "Sony": (1, 2.0, 146), "Anker": (1, 1.0, 33)}


def test_evidence_and_stems(spark, catalogue):
    products, reviews = catalogue
    found = search.review_scenario(reviews, products, ask(spark, "batteries dying problems"), "lucene", stemming=True)
    ids = [s.review_id for s in found.snippets.orderBy("rank").collect()]
    assert set(ids) == {"R1", "R3", "R4"} and ids[0] == "R3"
    assert "<em>battery" in found.snippets.filter("review_id = 'R3'").first().snippet
    hit = found.hits.filter("review_id = 'R3'").first()
    assert hit.review_title == "Battery problem" and hit.highlights["review_text"] == hit.highlights["text"]


def test_stemmed_index_equals_stemming_every_word(spark, catalogue):
    index = search.review_index(catalogue[1])
    got = Counter(r.term for r in index.stemmed(postings.stem_table(index.positions)).positions.collect())
    assert got == Counter(stem_word(r.term) for r in index.positions.collect())


def test_published_stems():
    assert {w: stem_word(w) for w in STEP_EXAMPLES} == STEP_EXAMPLES


@pytest.mark.parametrize("query, mood", [
    ("great quality", "positive"), ("poor quality", "positive"), ("goodness", "positive"), ("it WORKS WELL", "positive"),
    ("battery dies", "negative"), ("", "negative"),
])
def test_mood(spark, query, mood):
    assert ask(spark, query).select(filters.sentiment(F.col("q"))).first()[0] == mood


def test_english_review_analyzer(spark):
    terms = ask(spark, "The Café's batteries aren’t in John's bag").select(ENGLISH_REVIEW.terms(F.col("q"))).first()[0]
    assert terms == ["cafe", "batteries", "aren’t", "john", "bag"]


def damerau(a, b):
    """Unrestricted Damerau-Levenshtein distance, the textbook way."""
    last, far = {}, len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        column = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), column
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, column = 0, j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1,
                          d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_edit_distance_and_deletion_join_against_brute_force(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))) for _ in range(220)})
    asked = words[::6]
    pairs = [(a, b) for a in asked for b in words]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("d", edit_distance(F.col("a"), F.col("b")))
    for r in df.collect():
        assert r.d == min(damerau(r.a, r.b), 3), (r.a, r.b)
    allowed = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    expected = {(a, b, damerau(a, b)) for a, b in pairs if damerau(a, b) <= allowed(a)}
    vocab = spark.createDataFrame([("f", w) for w in words], "field string, term string")
    found = fuzzy.similar_terms(spark.createDataFrame([("f", w) for w in asked], "field string, term string"), vocab)
    assert {(r.q_term, r.term, r.typos) for r in found.collect()} == expected


def test_deletion_keys_of_long_words_stay_few_and_find_every_near_word(spark):
    rng = random.Random(6)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(5, 16))) for _ in range(60)}
    for word in sorted(words)[::2]:
        for _ in range(4):  # near words: one or two letters left out, put in, replaced or exchanged
            near = list(word)
            for _ in range(rng.randint(1, 2)):
                i = rng.randrange(len(near) - 1)
                near[i:i + 2] = rng.choice([[near[i]], [*near[i:i + 2], "b"], [near[i], "c"], near[i:i + 2][::-1]])
            words.add("".join(near))
    words, allowed = sorted(words), lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    asked = words[::3]
    expected = {(a, b, d) for a in asked for b in words if (d := damerau(a, b)) <= allowed(a)}
    vocab = spark.createDataFrame([("f", w) for w in words], "field string, term string")
    wanted = spark.createDataFrame([("f", w) for w in asked], "field string, term string")
    for keys in (None, fuzzy.deletion_index(vocab)):
        found = fuzzy.similar_terms(wanted, vocab, keys=keys)
        assert {(r.q_term, r.term, r.typos) for r in found.collect()} == expected
    long = spark.createDataFrame([("f", "abcdefghijklmnopqrstuvwxyz")], "field string, term string")
    assert fuzzy.deletion_index(long).count() <= 1 + 7 + 21


@pytest.mark.parametrize("a, b, d", [("ca", "abc", 2), ("wireles", "wireless", 1), ("wiht", "with", 1), ("same", "same", 0)])
def test_edit_distance_examples(spark, a, b, d):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(edit_distance(F.col("a"), F.col("b"))).first()[0] == d


def test_minimum_match_table(spark):
    rows = [(n, m) for n in (1, 2, 3, 5, 10) for m in range(1, n + 1)]
    kept = match.minimum_match(spark.createDataFrame(rows, "n_terms int, matched int")).groupBy("n_terms").agg(F.min("matched"))
    assert dict(map(tuple, kept.collect())) == {1: 1, 2: 2, 3: 2, 5: 3, 10: 7}


def test_fuzzy_finds_all_that_exact_finds(spark, folder):
    index = search.product_index(views.products(spark, folder))
    terms = postings.query_terms(ask(spark, "red widget", "small ring"), index.fields)
    exact = match.any_term_match(index, terms).select("query_id", "doc_id")
    near = match.any_term_match(index, fuzzy.expand_terms(terms, postings.vocabulary(index))).select("query_id", "doc_id")
    assert exact.count() > 0 and exact.exceptAll(near).count() == 0


def test_covers_against_brute_force(spark):
    rng = random.Random(3)
    docs = {d: [rng.choice("abcx") for _ in range(rng.randint(3, 14))] for d in range(40)}
    rows = [(1, 0, d, i, "abc".index(w), 3, 1.0) for d, ws in docs.items() for i, w in enumerate(ws, 1) if w in "abc"]
    hits = spark.createDataFrame(rows, "query_id int, grp int, doc_id int, pos int, slot int, n_terms int, weight double")
    got = {(r.doc_id, r.start, r.end) for r in rank.covers(hits, ["query_id", "grp", "doc_id"]).collect()}
    expected = set()
    for d, ws in docs.items():
        full = [(i, j) for i in range(len(ws)) for j in range(i, len(ws)) if {"a", "b", "c"} <= set(ws[i:j + 1])]
        expected |= {(d, i + 1, j + 1) for i, j in full if not any(i <= k and m <= j and (k, m) != (i, j) for k, m in full)}
    # Spans that share a start keep the shortest; those ending inside a longer one are minimal as well.
    assert expected <= got
    assert {(d, s) for d, s, _ in got} == {(d, s) for d, s, _ in expected}


def test_covers_of_thirty_words(spark):
    rng = random.Random(5)
    rows = [(1, 0, 1, pos, slot, 30, 1.0) for pos, slot in enumerate([*range(30), *(rng.randrange(30) for _ in range(400))], 1)]
    rows += [(2, 0, 1, pos, slot, 2, w) for pos, slot, w in [(1, 0, 1.0), (4, 1, 0.5), (5, 0, 0.25), (9, 0, 1.0)]]
    names = "query_id int, grp int, doc_id int, pos int, slot int, n_terms int, weight double"
    got = rank.covers(spark.createDataFrame(rows, names), ["query_id", "grp", "doc_id"]).collect()
    last, expected = {}, {}
    for _, _, _, pos, slot, _, _ in rows[:430]:
        last[slot] = pos
        if len(last) == 30:
            expected.setdefault(min(last.values()), pos)
    assert {r.start: r.end for r in got if r.query_id == 1} == expected
    assert {(r.start, r.end, r.weight) for r in got if r.query_id == 2} == {(1, 4, 2 / 3), (4, 5, 2 / 6)}


def test_trigram_similarity_by_hand(spark):
    got = trigram.similar(ask(spark, "cat"), "query_id", "q", ask(spark, "cat", "cart"), 0.1).collect()
    assert {(r.query_id, r.similarity) for r in got} == {(1, 1.0), (2, round(2 / 7, 6))}
    assert ask(spark, "ab").select(word_trigrams(F.col("q"))).first()[0] == ["  a", " ab", "ab "]


def test_dense_fills_all_dimensions(spark):
    rows = [(1, 0, 0.5), (1, 3, -1.0), (2, 4, 2.0), (2, 2, 1.0), (3, 7, 1.0)]
    got = vectors.dense(spark.createDataFrame(rows, "doc_id int, dim int, weight double"), 5).collect()
    assert {r.doc_id: r.embedding for r in got} == {1: [0.5, 0, 0, -1.0, 0], 2: [0, 0, 1.0, 0, 2.0], 3: [0] * 5}


def test_scores_of_candidates_are_rounded_half_up(spark):
    # Cosine 0.578499: half of 1.578499 is 0.7892495, which as a double lies below that.
    angle = np.arccos(0.578499)
    near = spark.createDataFrame([(1, [float(np.cos(angle)), float(np.sin(angle))])], "doc_id int, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    row = vectors.candidate_neighbours(near, asked, 1, 2).first()
    assert (row.cosine, row.score) == (0.578499, 0.78925)


def test_minimum_match_equals_looking_at_every_pair(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words, weights=range(1, 31), k=rng.randrange(0, 25))) for _ in range(300)]
    asked = [" ".join(rng.choices(words, weights=range(1, 31), k=n)) for n in range(1, 16)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    index = postings.TextIndex.of(docs, [postings.IndexField("t")], "id")
    terms = postings.query_terms(ask(spark, *asked), index.fields).withColumn("weight", F.lit(1.0))
    # Each slot may also be spelled as the word before it.
    other = terms.withColumn("term", F.concat(F.lit("w"), F.substring("term", 2, 2).cast("int") - 1)).withColumn("weight", F.lit(0.5))
    for spelled in (terms, terms.unionByName(other)):
        whole = match.minimum_match(match.field_scores(index, spelled)).collect()
        got = match.minimum_match_scores(index, spelled).collect()
        key = lambda r: (r.query_id, r.doc_id, r.field, r.matched, round(r.score, 9))
        assert len(whole) > 100 and {key(r) for r in got} == {key(r) for r in whole}


def test_trigram_similarity_keeps_every_pair_that_shares_one(spark):
    texts = ["small ring", "ring of a thousand very long words that share next to nothing", "blue", "", "red"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    asked = ["rign", "red widgte", "qqq", ""]
    got = {(r.query_id, r.doc_id): r.similarity for r in trigram.similarity(docs, "id", "t", ask(spark, *asked)).collect()}
    pairs = {(q, d): (grams(a), grams(b)) for q, a in enumerate(asked, 1) for d, b in enumerate(texts)}
    assert got == {key: round(len(a & b) / len(a | b), 6) for key, (a, b) in pairs.items() if a & b}
    assert 0 < min(got.values()) < 0.1


def test_the_trigram_join_has_no_threshold(spark, folder):
    products = views.products(spark, folder).select("product_id", "description").collect()
    found = matching.trigram_join(spark, folder).collect()
    asked = {q: grams(text) for q, text in matching._GRAM_QUERIES}
    assert len(found) == sum(bool(a & grams(p.description)) for a in asked.values() for p in products)
    assert min(r.similarity for r in found) < 0.2


def test_price_buckets_and_filters(spark, catalogue):
    products, _ = catalogue
    got = {r.value: r.n for r in facets.range_buckets(products, "price").collect()}
    assert got == {"*-50.0": 1, "50.0-100.0": 1, "100.0-300.0": 1, "300.0-*": 3}
    nothing = facets.range_buckets(products.filter("price < 0"), "price").collect()
    assert [r.n for r in nothing] == [0, 0, 0, 0]
    kept = products.filter(filters.ProductFilter(min_price=50, max_price=100).predicate())
    assert {r.product_id for r in kept.collect()} == {"B3", "B4"}
    with pytest.raises(ValueError):
        filters.equals({"price": 3}, ["brand"])


def test_bundle_fills_gaps_and_adds_up(spark, catalogue):
    products, reviews = catalogue
    rows = reviews.join(products.select("product_id", "brand", "category"), "product_id").withColumn("query_id", F.lit(1))
    bundle = facets.analytics_bundle(rows).collect()
    assert {r.value: r.n for r in bundle if r.facet == "rating"} == {"1.0": 2, "2.0": 1, "3.0": 0, "4.0": 1, "5.0": 1}
    for facet in ("brand", "category", "rating", "summary"):
        assert sum(r.n for r in bundle if r.facet == facet) == len(REVIEWS)


def test_rounding(spark):
    row = spark.range(1).select(facets.half_even(F.lit(1.125)).alias("e"), facets.half_up(F.lit(1.125)).alias("u")).first()
    assert (row.e, row.u) == (1.12, 1.13)


def test_upsert_is_idempotent_and_duplicates_resolve(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    incoming = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 3)], "k int, v string, ord int")
    once = tables.upsert(target, incoming, "k", "ord")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(tables.upsert(once, incoming, "k", "ord").collect()) == sorted(once.collect())
    kept = tables.insert_if_absent(target, incoming.withColumn("k", F.col("k") + 1), "k", "ord")
    assert sorted(map(tuple, kept.collect())) == [(1, "a"), (2, "b"), (3, "x"), (4, "z")]


def test_latency_quantile_is_exact(spark):
    rng = random.Random(1)
    data = [("skewed", 5.0)] * 700 + [("skewed", rng.expovariate(0.01)) for _ in range(300)] + [("one", 3.0)]
    data += [("same", 2.0)] * 50 + [("outlier", rng.random()) for _ in range(400)] + [("outlier", 1e15)]
    got = {r.g: r for r in review_stats.latency_stats(spark.createDataFrame(data, "g string, x double"), "x", ["g"]).collect()}
    for g, r in got.items():
        values = sorted(x for k, x in data if k == g)
        assert r.p95_ms == values[min(len(values) - 1, round((len(values) - 1) * 0.95))]
        assert (r["count"], r.min_ms, r.max_ms) == (len(values), values[0], values[-1])


def test_first_n_and_numbers_on_clumped_keys(spark):
    keys = sorted({*range(3000), *range(10**9, 10**9 + 2000), 5 * 10**11})
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(7)
    assert sorted(r.k for r in limits.first_n(df, 3500, "k").collect()) == keys[:3500]
    assert limits.first_n(df, 10**6, "k").count() == len(keys)
    rows = {r.k: r.row_no for r in limits.numbered(df, "k").collect()}
    assert rows == {k: i for i, k in enumerate(keys, 1)}


def test_order_with_an_outlier_and_fractions(spark):
    rng = random.Random(7)
    values = sorted({rng.random() for _ in range(4000)} | {1e15, -1e15})
    df = spark.createDataFrame([(v, f"{v:.17f}") for v in values], "v double, t string").repartition(6)
    assert sorted(r.v for r in limits.first_n(df, 2500, "v").collect()) == values[:2500]
    assert {r.v: r.row_no for r in limits.numbered(df, "v").collect()} == {v: i for i, v in enumerate(values, 1)}
    assert sorted(r.t for r in limits.first_n(df, 3000, "t").collect()) == sorted(f"{v:.17f}" for v in values)[:3000]
    sizes = limits.dealt(df, "v").groupBy("_part").count().collect()
    assert len(sizes) > 4 and max(r["count"] for r in sizes) < len(values) / 2
    for page in (1, 20, 40, 41):
        rows = limits.page_of(df, [F.desc("v")], page, 100).collect()
        assert [r.v for r in rows] == values[::-1][(page - 1) * 100:page * 100], page


def test_gaps_are_filled_however_far_the_next_bucket_lies(spark, monkeypatch):
    df = spark.createDataFrame([(1, 2.5), (1, 70_001.0), (1, 2.1), (2, -3.0), (2, None)], "g int, x double")
    got = facets.histogram(df, "x", by=["g"]).collect()
    first = {r.value: r.n for r in got if r.g == 1}
    assert len(got) == len(first) + 1 and len(first) == 70_000 and (first[2.0], first[3.0], first[70_001.0]) == (2, 0, 1)
    plain = facets.histogram(df.filter("g = 1"), "x", 1000.0).collect()
    assert [r.n for r in sorted(plain)] == [2] + [0] * 69 + [1]
    monkeypatch.setattr(facets, "GAP_STEP", 4)
    slots = spark.createDataFrame([(-200,), (0,), (1,), (255,)], "slot long")
    filled = facets.gaps_filled(slots, "slot", Window.orderBy("slot"), [], "at").collect()
    assert sorted(r["at"] for r in filled) == list(range(-200, 256)) and all(r.slot <= r["at"] for r in filled)


def grams(text):
    return {w[i:i + 3] for word in re.findall(r"[^\W_]+", text.lower()) for w in [f"  {word} "] for i in range(len(w) - 2)}


@pytest.mark.parametrize("threshold", [0.1, 0.3, 0.6, 1.0])
def test_trigram_join_equals_all_pairs_and_looks_at_few_more(spark, threshold):
    rng = random.Random(3)
    words = ["small", "ring", "red", "widget", "smaller", "rings", "blue", "bolt", "anvil", "hot", "gear", "économie", "a", "plate"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))) for _ in range(400)]
    asked = ["red widgte", "small rign", "hot gear", "qqq", "", "smallest rings of all", "a", "red", "économie"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {(r.query_id, r.doc_id): r.similarity for r in trigram.similar(docs, "id", "t", ask(spark, *asked), threshold).collect()}
    wanted = {}
    for q, query in enumerate(asked, 1):
        for d, text in enumerate(texts):
            a, b = grams(query), grams(text)
            if a | b and round(len(a & b) / len(a | b), 6) >= threshold:
                wanted[q, d] = round(len(a & b) / len(a | b), 6)
    assert got == wanted
    sets = docs.select(F.col("id").alias("doc_id"), word_trigrams(F.col("t")).alias("grams"))
    sides = ask(spark, *asked).select("query_id", word_trigrams(F.col("q")).alias("q_grams"))
    looked_at = trigram.candidate_pairs(sets, sides, threshold).count()
    assert len(wanted) <= looked_at < 3 * len(wanted)


def test_inflected_words_stop_words_and_exclusions_in_the_weighted_flows(spark, catalogue):
    products, reviews = catalogue
    rows = products.withColumn("review_text", F.when(F.col("product_id") == "B6", "Charged the batteries twice").otherwise(""))
    queries = ask(spark, "wireless headphone", "the wireless headphones", "Wireless headphones are", "-wireless", "batteries", "mice or -wired",
                  '"noise canceling"', "-the", "wireless -mouse")

    def ids(result):
        found = {}
        for r in result.hits.collect():
            found.setdefault(r.query_id, []).append(r.product_id)
        return {q: sorted(v) for q, v in found.items()}

    wanted = {1: ["B1", "B2"], 2: ["B1", "B2"], 3: ["B1", "B2"], 4: ["B3", "B5", "B6"], 5: ["B5", "B6"], 7: ["B1"], 9: ["B1", "B2"],
              6: ["B1", "B2", "B3", "B4", "B5", "B6"]}
    scenario = search.product_scenario(rows, queries, "weighted")
    found = ids(scenario)
    # The category of the mice is "Mice", whose stem is not that of "mouse".
    assert found == {**wanted, 6: ["B1", "B2", "B3", "B4", "B5", "B6"]}
    assert {r.query_id: r.total for r in scenario.totals.collect()} == {q: len(v) for q, v in found.items()}
    marks = {(r.query_id, r.product_id): r.highlights["title"][0] for r in scenario.hits.collect()}
    assert marks[1, "B2"] == "Bose Quiet <mark>Wireless</mark> <mark>Headphones</mark>" and marks[5, "B5"] == "<mark>Battery</mark> Pack"
    basic = ids(search.basic_product_search(rows, queries, "weighted"))
    assert all(set(wanted[q]) <= set(basic[q]) for q in wanted)
    evidence = search.review_scenario(reviews, products, ask(spark, "problems of batteries", "-problem"), "weighted")
    assert sorted((r.query_id, r.review_id) for r in evidence.hits.collect()) == [(1, "R1"), (1, "R3")]


def test_ladder_marks_the_spelling_that_matched(spark, catalogue):
    hits = search.product_scenario(catalogue[0], ask(spark, "wirelss mouse"), "ladder").hits.collect()
    marks = {r.product_id: r.highlights["title"][0] for r in hits}
    assert marks["B4"] == "<em>Wireless</em> <em>Mouse</em>"


def test_later_stems(spark):
    words = dict(zip(LATER_WORDS.split(), LATER_STEMS.split(), strict=True))
    assert {w: later_stem(w) for w in words} == words


def test_both_stemmers_equal_their_sql(spark):
    import duckdb

    rng = random.Random(11)
    ends = [*LATER_STEP_2, *LATER_STEP_3, *LATER_STEP_4, "s", "es", "ed", "ing", "eed", "edly", "ingly", "y", "ies", "e", "l", "ll", ""]
    words = {"".join(rng.choice("aeioybcdlstnwxr") for _ in range(rng.randint(1, 5))) + "".join(rng.choices(ends, k=rng.randint(0, 3)))
             for _ in range(20_000)} | set(WHOLE_WORDS) | {"été", "a1", "x"}
    con = duckdb.connect()
    con.execute("CREATE TABLE words AS SELECT unnest(?) AS term", [sorted(words)])
    for chain, function in ((later_stems_sql, later_stem), (stems_sql, stem_word)):
        found = con.execute(f"WITH {chain('words', 'stems')} SELECT term, stem FROM stems").fetchall()
        assert {w: s for w, s in found} == {w: function(w) for w in words}


def test_a_load_writes_the_buckets_of_its_keys(spark, tmp_path):
    store = tables.TableStore(spark, str(tmp_path / "store"), buckets=500)
    rows = spark.range(5000).select(F.col("id").cast("string").alias("k"), F.lit("old").alias("v"), F.col("id").alias("ord"))
    store.load("t", rows, "k", "ord")
    before = set(store.files("t"))
    some = rows.filter("id % 1000 = 0").withColumn("v", F.lit("new")).union(spark.createDataFrame([("x", "new", 1), ("x", "newer", 2)], rows.schema))
    after = set(store.load("t", some, "k", "ord").inputFiles())
    assert len(after - before) <= 6 and len(before - after) <= 6 and len(before) > 300
    assert {r.v: r["count"] for r in store.read("t").groupBy("v").count().collect()} == {"old": 4995, "new": 5, "newer": 1}
    store.load("t", some.withColumn("v", F.lit("never")), "k", "ord", keep="first")
    assert store.read("t").filter("v = 'never'").count() == 0 and store.read("t").count() == 5001
    assert store.load("t", some, "k", "ord", reset=True).count() == 6
    assert store.load("empty", some.limit(0), "k", "ord").count() == 0


def test_highlight_fragments(spark):
    text = "zero " * 30 + "the battery and the problem here " + "zero " * 30 + "battery"
    df = spark.createDataFrame([(text, ["battery", "problem"])], "t string, terms array<string>")
    best = df.select(highlight.best_fragment(F.col("t"), F.col("terms"), 8)).first()[0]
    assert best.count("<mark>") == 2 and len(best.split()) == 8
    parts = df.select(highlight.fragments(F.col("t"), F.col("terms"), 60, 5)).first()[0]
    assert len(parts) == 2 and parts[0].count("<em>") == 2 and all(len(p) <= 60 + 18 for p in parts)
    joined = df.select(F.regexp_extract_all("t", F.lit(highlight._CHUNK.format(size=60)), F.lit(0))).first()[0]
    assert "".join(joined) == text
    empty = spark.createDataFrame([("", ["a"])], "t string, terms array<string>")
    assert empty.select(highlight.best_fragment(F.col("t"), F.col("terms"), 8)).first()[0] == ""


def _vectors(spark, n, d=16, seed=1):
    rows = np.random.RandomState(seed).standard_normal((n, d))
    return rows, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "doc_id long, embedding array<float>")


def test_exact_neighbours_few_and_many_queries_agree(spark, monkeypatch):
    rows, df = _vectors(spark, 400)
    queries = df.filter("doc_id < 30").withColumnRenamed("doc_id", "query_id")
    few = vectors.exact_neighbours(df, queries, 5).select("query_id", "doc_id", "rank").collect()
    unit = (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float64)
    for q in (0, 7, 29):
        order = np.argsort(-(unit @ unit[q]))[:5].tolist()
        assert [r.doc_id for r in sorted(few, key=lambda r: r["rank"]) if r.query_id == q] == order
    monkeypatch.setattr(vectors, "_QUERIES_PER_BLOCK", 8)
    monkeypatch.setattr(vectors, "_VECTORS_PER_BLOCK", 90)
    many = vectors.exact_neighbours(df, queries, 5).select("query_id", "doc_id", "rank").collect()
    assert sorted(few) == sorted(many)


def test_candidate_recall(spark, folder):
    import __spark_entry__ as entry

    shares = [r.recall for r in entry.queries()["f14_candidate_recall"](spark, folder).collect()]
    assert sum(shares) / len(shares) >= 0.9


def test_model_batches_and_retries(spark):
    calls = spark.sparkContext.accumulator(0)
    failed = []

    def model(texts):
        calls.add(1)
        assert len(texts) <= 4
        if not failed:
            failed.append(1)
            raise RuntimeError("busy")
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "id int, t string").coalesce(1)
    got = vectors.embed_column(df, "id", "t", model, batch=4, delay=0.0).collect()
    assert {r.doc_id: r.embedding[0] for r in got} == {i: float(i) for i in range(10)}
    assert calls.value == 4


def test_folding_to_stems_reads_the_texts_once(spark):
    reads, n = spark.sparkContext.accumulator(0), 50

    def counted(frames):
        for frame in frames:
            reads.add(len(frame))
            yield frame

    rows = spark.range(n).selectExpr("id AS doc_id", "concat('batteries battery word', id % 7) AS text")
    index = postings.TextIndex.of(rows.mapInPandas(counted, rows.schema), [postings.IndexField("text")], "doc_id")
    sharing = spark.createDataFrame([("text", w, "batteri") for w in ("battery", "batteries")], "field string, term string, stem string")
    folded = postings.folded_to_stems(index, sharing)
    assert [folded.positions.filter(F.col("term") == "batteri").count() for _ in range(2)] == [2 * n, 2 * n]
    assert reads.value == n
