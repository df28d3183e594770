import json

import pytest

from shelfsift import jobs
from tests.sample import RAW_PRODUCTS, RAW_REVIEWS, lines


def write(folder, name, rows):
    path = folder / name
    path.write_text("\n".join(lines(rows)) + "\n")
    return str(path)


def run(capsys, *argv):
    assert jobs.main(argv) == 0
    return json.loads(capsys.readouterr().out.strip().splitlines()[-1])["wrote"]


def test_jobs_from_raw_lines_to_answers(spark, tmp_path, capsys):
    products, reviews = write(tmp_path, "products.jsonl", RAW_PRODUCTS), write(tmp_path, "reviews.jsonl", RAW_REVIEWS)
    sources = ["--products", str(tmp_path / "nothing"), "--products", products, "--reviews", reviews]
    few = run(capsys, "prepare", *sources, "--output", str(tmp_path / "few"), "--product-limit", "2", "--max-reviews-per-product", "1")
    assert few == {"product_count": 2, "review_count": 2}
    out, store = str(tmp_path / "processed"), str(tmp_path / "store")
    assert run(capsys, "prepare", *sources, "--output", out, "--all", "--product-limit", "1") == {"product_count": 6, "review_count": 9}
    assert run(capsys, "load", "--processed", out, "--store", store, "--no-embeddings")["products"] == 5

    queries = write(tmp_path, "queries.jsonl", [{"query_id": 7, "q": "wireles headphnes"}, {"query_id": 8, "q": "nothing such"}])
    wrote = run(capsys, "search", "--store", store, "--queries", queries, "--output", str(tmp_path / "found"), "--max-price", "300")
    assert set(wrote["lucene"]) == {"hits", "totals", "facets"}
    hits = spark.read.json(str(tmp_path / "found/lucene/hits")).collect()
    assert [(h.query_id, h.product_id) for h in hits] == [(7, "P1")]
    wrote = run(capsys, "search", "--store", store, "--q", "cable breaks", "--flow", "reviews", "--dialect", "ladder",
                "--output", str(tmp_path / "evidence"))
    assert wrote["ladder"]["hits"] == wrote["ladder"]["snippets"] == 1
    wrote = run(capsys, "search", "--store", store, "--q", "cab", "--flow", "complete", "--dialect", "all", "--output", str(tmp_path / "ends"))
    assert wrote["all"]["titles"] == 1


def test_a_search_needs_a_query(tmp_path):
    with pytest.raises(SystemExit):
        jobs.main(["search", "--store", str(tmp_path), "--output", str(tmp_path)])
