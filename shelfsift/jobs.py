"""The flows as jobs: ``spark-submit --py-files ... shelfsift/jobs.py prepare|load|search ...`` or ``shelfsift-job ...``.

The session comes from the submitter, who names the shared folder in ``spark.checkpoint.dir``. Every job writes to the
folder it is given and prints one JSON line.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from shelfsift.functions.filters import ProductFilter
from shelfsift.plans import analytics, autocomplete, load, prepare, search
from shelfsift.sources import jsonl
from shelfsift.sources.tables import TableStore

# The first products and the reviews of each that a preparation takes if nothing else is asked for.
PRODUCT_LIMIT, REVIEWS_PER_PRODUCT = 100_000, 5

FLOWS = ["products", "scenario", "reviews", "analytics", "complete"]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="shelfsift-job", description=__doc__)
    jobs = top.add_subparsers(dest="job", required=True)

    one = jobs.add_parser("prepare", help="raw product and review lines to processed files with a manifest")
    one.add_argument("--products", action="append", required=True, help="lines, plain or gzip; of several the first that exists")
    one.add_argument("--reviews", action="append", required=True, help="the same for reviews; a path that doesn't exist means none")
    one.add_argument("--output", required=True)
    one.add_argument("--product-limit", type=int, default=PRODUCT_LIMIT)
    one.add_argument("--max-reviews-per-product", type=int, default=REVIEWS_PER_PRODUCT, help="0: no limit")
    one.add_argument("--all", action="store_true", help="every product and review, whatever the limits")

    two = jobs.add_parser("load", help="processed files to keyed tables and indexes")
    two.add_argument("--processed", required=True)
    two.add_argument("--store", required=True)
    two.add_argument("--limit", type=int, default=0, help="first rows of either table only, 0: all")
    two.add_argument("--reset", action="store_true", help="start from empty tables")
    two.add_argument("--no-embeddings", action="store_true")
    two.add_argument("--no-indexes", action="store_true")

    three = jobs.add_parser("search", help="a table of queries over the loaded tables")
    three.add_argument("--store", required=True)
    three.add_argument("--queries", help="JSON lines of query_id and q")
    three.add_argument("--q", action="append", help="a query; they are numbered from 1")
    three.add_argument("--flow", choices=FLOWS, default="products")
    three.add_argument("--dialect", choices=[*search.DIALECTS, "all"], default="lucene")
    three.add_argument("--output", required=True)
    three.add_argument("--k", type=int, default=10)
    three.add_argument("--brand")
    three.add_argument("--category")
    # Filters are the products flow's; the others take none.
    for bound in ("--min-price", "--max-price", "--min-rating"):
        three.add_argument(bound, type=float)
    return top


def run_prepare(spark: SparkSession, args: argparse.Namespace) -> dict:
    limits = (None, None) if args.all else (args.product_limit, args.max_reviews_per_product or None)
    products = jsonl.first_existing(spark, args.products)
    reviews = next((p for p in args.reviews if jsonl.path_exists(spark, p)), args.reviews[-1])
    return prepare.run(spark, products, reviews, args.output, *limits)


def run_load(spark: SparkSession, args: argparse.Namespace) -> dict:
    tables = load.run(
        spark, args.processed, args.store, limit=args.limit, reset=args.reset,
        embeddings=not args.no_embeddings, indexes=not args.no_indexes)
    return {name: frame.count() for name, frame in tables.items()}


def _queries(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.queries:
        return spark.read.schema("query_id long, q string").json(args.queries)
    return spark.createDataFrame(list(enumerate(args.q or [], 1)), "query_id long, q string")


def _written(parts: dict[str, DataFrame | None], output: str) -> dict:
    found = {name: part for name, part in parts.items() if part is not None}
    return {name: jsonl.write_json_lines(part, f"{output}/{name}") for name, part in found.items()}


def _answers(flow: str, dialect: str, tables: tuple[DataFrame, DataFrame], queries: DataFrame,
             stored: search.SearchIndex, wanted: ProductFilter, k: int) -> dict[str, DataFrame | None]:
    products, reviews = tables
    if flow == "analytics":
        return vars(analytics.review_analytics(reviews, products, queries, dialect, stored=stored))
    if flow == "complete":
        result = autocomplete.search_as_you_type(products, queries, k, stored=stored)
        titles = autocomplete.suggest_titles(products, queries, k, stored=stored)
        return {"hits": result.hits, "totals": result.totals, "titles": titles}
    if flow == "reviews":
        result = search.review_scenario(reviews, products, queries, dialect, k, stored=stored)
    elif flow == "scenario":
        result = search.product_scenario(products, queries, dialect, k, stored=stored)
    else:
        result = search.basic_product_search(products, queries, dialect, wanted, k, stored)
    return vars(result)


def run_search(spark: SparkSession, args: argparse.Namespace) -> dict:
    store = TableStore(spark, args.store)
    products, reviews = store.read("product_documents"), store.read("review_documents")
    stored = load.stored_index(store, products, reviews)
    wanted = ProductFilter(args.brand, args.category, args.min_price, args.max_price, args.min_rating)
    queries = _queries(spark, args)
    dialects = search.DIALECTS if args.dialect == "all" and args.flow != "complete" else [args.dialect]
    return {dialect: _written(
        _answers(args.flow, dialect, (products, reviews), queries, stored, wanted, args.k), f"{args.output}/{dialect}")
        for dialect in dialects}


RUN = {"prepare": run_prepare, "load": run_load, "search": run_search}


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.job == "search" and not (args.queries or args.q):
        parser().error("search needs --queries or --q")
    spark = SparkSession.builder.appName(f"shelfsift-{args.job}").getOrCreate()
    print(json.dumps({"job": args.job, "wrote": RUN[args.job](spark, args)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
