from collections import defaultdict
from fractions import Fraction

import pytest

from shelfsift.llm import mixing


def filled(sizes, weights, epochs=3):
    target, open_, rest = {}, set(sizes), sum(sizes.values())
    while open_:
        share = sum(weights[s] for s in open_)
        over = {s for s in open_ if Fraction(weights[s] * rest, share) > epochs * sizes[s]}
        if not over:
            return target | {s: float(Fraction(weights[s] * rest, share)) for s in open_}
        for s in over:
            target[s] = float(epochs * sizes[s])
            rest -= epochs * sizes[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 1000, "b": 10, "c": 5, None: 1}, {"a": 5, "b": 5, "c": 5}, {"a": 0, "b": 100}, {"a": 10**12, "b": 1, "c": 7, "d": 3}])
def test_water_filling(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    rows = mixing.water_fill(mixing.cycled_weights(table)).collect()
    assert {r.source: r.target for r in rows} == pytest.approx(filled(sizes, {r.source: r.weight for r in rows}))


def test_water_filling_of_a_billion_words(spark):
    """Totals that are an int, times weights that are one, need not be one."""
    sizes = {"a": 600_000_000, "b": 500_000_000, "c": 400_000_000}
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    rows = mixing.water_fill(mixing.cycled_weights(table)).collect()
    assert {r.source: r.target for r in rows} == {"a": 250_000_000.0, "b": 500_000_000.0, "c": 750_000_000.0}
    table = spark.createDataFrame(list({"a": 900_000_000, "b": 100}.items()), "source string, source_size int")
    rows = mixing.water_fill(mixing.cycled_weights(table)).collect()
    assert {r.source: r.target for r in rows} == {"a": 900_000_100.0 - 300, "b": 300.0}


def test_words_taken_meet_the_targets(documents, odd):
    for docs in (documents, odd):
        rows = mixing.mix(docs).collect()
        taken, target = defaultdict(int), {}
        for r in rows:
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert 0 <= r.taken <= 3 * r.size
            assert r.size == len((r.text or "").encode().split())
        assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
        assert len(rows) == docs.count()


def test_reruns_agree_and_another_seed_differs(documents):
    def ids(seed, parts):
        return sorted(tuple(r) for r in mixing.mix(documents.repartition(parts), seed=seed).select("doc_id", "taken").collect())

    assert ids(1, 3) == ids(1, 7) != ids(2, 3)


def test_empty(empty):
    assert mixing.mix(empty).count() == 0
