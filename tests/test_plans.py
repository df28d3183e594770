"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfsift.functions.filters import ProductFilter
from shelfsift.functions.stem import english_stem, stem
from shelfsift.functions.text import ENGLISH_TEXT
from shelfsift.operators import highlight, limits, match, postings, suggest, trigram
from shelfsift.plans import autocomplete, search
from shelfsift.sources import views

SEARCH_QUERIES = [
    "d05_rows_by_one_query_row", "d06_term_join", "d08_trigram_join", "f01_any_term_relevance", "f02_boosted_best_field",
    "f03_fuzzy_boosted_match", "f05_search_as_you_type", "f07_boolean_phrase_match", "f08_weighted_frequency_rank",
    "f09_cover_density_rank", "f11_composite_basic_search", "f12_ladder_search", "h02_best_fragment",
    "p06_review_analytics_weighted",
]


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().executedPlan().toString() if mode == "tree" else df._sc._jvm.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), mode)


@pytest.mark.parametrize("name", SEARCH_QUERIES)
def test_no_products_of_tables_and_no_python_on_the_search_path(spark, folder, name):
    text = plan(entry.queries()[name](spark, folder), "tree")
    assert not re.search("CartesianProduct|NestedLoopJoin", text)
    assert not re.search("ArrowEvalPython|BatchEvalPython|MapInPandas", text)


def test_filters_and_columns_reach_the_scan(spark, folder):
    test = ProductFilter(brand="Brand#17", min_price=50).predicate()
    text = plan(views.products(spark, folder).filter(test).select("product_id"))
    assert "EqualTo(p_brand,Brand#17)" in text
    assert "p_retailprice" not in text


def test_ranks_are_cut_before_the_shuffle(spark, folder):
    docs = views.table(spark, folder, "documents").select(F.col("lang").alias("query_id"), "doc_id", "n_chars")
    text = plan(limits.top_k(docs, 10, [F.desc("n_chars"), F.asc("doc_id")]), "tree")
    assert text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_small_queries_leave_the_postings_where_they_are(spark, folder):
    index = search.review_index(views.reviews(spark, folder))
    queries = spark.createDataFrame([(1, "with from")], "query_id int, q string")
    text = plan(match.any_term_match(index, postings.query_terms(queries, index.fields)), "tree")
    assert "SortMergeJoin" not in text.split("posexplode")[0]


def test_written_postings_open_only_the_folders_of_the_terms(spark, folder, tmp_path):
    index = search.product_index(views.products(spark, folder))
    index.save(str(tmp_path / "index"))
    kept = postings.TextIndex.load(spark, str(tmp_path / "index"), index.fields)
    queries = spark.createDataFrame([(1, "red widget")], "query_id int, q string")
    terms = postings.query_terms(queries, index.fields)
    found = match.any_term_match(kept, terms)
    assert re.search(r"PartitionFilters: \[.*term_bucket", plan(found))
    assert sorted(found.collect()) == sorted(match.any_term_match(index, terms).collect())


def test_completion_reads_the_stored_words_only(spark, folder, tmp_path):
    products = views.products(spark, folder)
    autocomplete.title_index(products).save(str(tmp_path / "titles"))
    kept = search.SearchIndex(titles=postings.TextIndex.load(spark, str(tmp_path / "titles"), suggest.suggest_fields()))
    queries = spark.createDataFrame([(1, "sm"), (2, "red wi")], "query_id int, q string")
    scores = suggest.prefix_search(kept.titles, queries)
    assert "p_name" not in plan(scores, "tree")
    read = autocomplete.search_as_you_type(products, queries, stored=kept).hits.select("query_id", "product_id", "score").collect()
    live = autocomplete.search_as_you_type(products, queries).hits.select("query_id", "product_id", "score").collect()
    assert sorted(read) == sorted(live) and live


def test_texts_are_not_shuffled_for_labels_that_nobody_reads(spark, folder):
    reviews = views.reviews(spark, folder)
    positions = search.class_positions(reviews, match.REVIEW_CLASSES, "review_id", ENGLISH_TEXT)
    assert "Join" not in plan(positions, "tree")
    # The rows of a page are cut out below the join that their ratings need.
    page = spark.createDataFrame([("3",), ("5",)], "doc_id string")
    shown = highlight.rows_of(reviews, "review_id", page)
    assert re.search(r"doc_id\S* as string\) IN \(3,5\)", plan(shown))
    assert sorted(shown.collect()) == sorted(reviews.filter("review_id IN ('3', '5')").collect())


def test_documents_with_several_labels_stay_several_reviews(spark, folder, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "web", 6) for i in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 0, 0), (1, 1, 1), (2, None, 1), (None, 1, 1), (None, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = views.reviews(spark, str(tmp_path)).select("review_id", "rating", "text").collect()
    assert sorted(found) == [("0", 1.0, "text 0"), ("1", 1.0, "text 1"), ("1", 2.0, "text 1"), ("2", 2.0, "text 2"), ("3", 4.0, "text 3")]


def test_trigram_pairs_are_counted_where_the_texts_lie(spark, folder):
    queries = spark.createDataFrame([(1, "red widget")], "query_id int, q string")
    text = plan(trigram.similar(views.products(spark, folder), "product_id", "title", queries), "tree")
    assert len(re.findall(r"Exchange hashpartitioning\(doc_id", text)) == text.count("Exchange hashpartitioning(doc_id") >= 1
    assert not re.search(r"Exchange hashpartitioning\((doc_id|query_id)[^)]*, *(query_id|doc_id)", text)


def test_many_queries_take_the_shuffle_path_with_the_same_result(spark, folder, monkeypatch):
    index = search.product_index(views.products(spark, folder))
    queries = spark.createDataFrame([(1, "red widget"), (2, "small ring")], "query_id int, q string")
    terms = postings.query_terms(queries, index.fields)
    small = sorted(match.any_term_match(index, terms).collect())
    monkeypatch.setattr(match, "is_small", lambda df: False)
    assert sorted(match.any_term_match(index, terms).collect()) == small


def test_stemmer_stays_above_the_distinct_words(spark, folder):
    """A join on the stem adds a condition on it, which must not reach the postings."""
    positions = search.review_index(views.reviews(spark, folder)).positions
    wanted = spark.createDataFrame([("thing",)], "stem string")
    for stemmer in (stem, english_stem):
        text = plan(postings.stem_table(positions, stemmer).join(wanted, "stem"), "tree")
        assert "EvalPython" not in text.split("HashAggregate")[-1]
        assert text.rindex("MapInPandas") < text.index("HashAggregate")


def test_stemmed_postings_are_made_once(spark, folder):
    positions = search.class_positions(views.reviews(spark, folder), match.REVIEW_CLASSES, "review_id", ENGLISH_TEXT)
    queries = spark.createDataFrame([(1, "thing or -great")], "query_id int, q string")
    asked = search.weighted_query(positions, queries, ENGLISH_TEXT)
    assert not re.search("Scan parquet|Generate", plan(asked.positions, "tree"))


def test_raw_lines_are_dealt_out_and_their_kinds_read_once(spark, folder):
    text = plan(entry.queries()["b05_normalize_product"](spark, folder), "tree")
    assert text.index("Generate") < text.index("Exchange hashpartitioning(ord")
    # Once for all keys of a line, for the last category, and for the two keys of the details.
    assert len(re.findall("schema_of_variant", text)) <= 6


def test_words_of_candidates_are_added_up_where_the_documents_lie(spark, folder):
    index = postings.TextIndex.of(views.table(spark, folder, "documents"), [postings.IndexField("text")], "doc_id")
    queries = spark.createDataFrame([(1, "with from this that")], "query_id int, q string")
    text = plan(match.minimum_match_scores(index, postings.query_terms(queries, index.fields)), "tree")
    assert "REPARTITION_BY_COL" not in text


def test_texts_are_embedded_once_for_candidates_and_totals(spark, folder):
    text = plan(entry.queries()["p08_semantic_comparison"](spark, folder), "tree")
    assert "md5" not in text and "MapInPandas" not in text


def test_postings_are_not_sorted_to_meet_their_stems(spark, folder):
    docs = views.table(spark, folder, "documents")
    index = postings.TextIndex.of(docs, [postings.IndexField("text")], "doc_id")
    text = plan(index.stemmed(postings.stem_table(index.positions)).positions, "tree")
    assert "ShuffledHashJoin" in text and "SortMergeJoin" not in text
