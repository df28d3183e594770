import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfsift.llm import toxicity


@pytest.fixture(scope="module")
def labels(spark, folder):
    return spark.read.parquet(f"{folder.rsplit('/', 1)[0]}/sf0.1/labels.parquet")


@pytest.fixture(scope="module")
def labelled(spark, folder):
    return spark.read.parquet(f"{folder.rsplit('/', 1)[0]}/sf0.1/documents.parquet")


def test_held_out_rows(labelled, labels):
    model = toxicity.train(labelled, labels.filter("doc_id % 2 = 0"))
    held = labelled.join(labels.filter("doc_id % 2 = 1"), "doc_id")
    rows = held.select("toxic", toxicity.severity(model, F.col("text")).alias("s")).select("toxic", "s.*").collect()
    hits = [r for r in rows if r.toxic_probability >= 0.5]
    assert sum(r.toxic for r in hits) / len(hits) > 0.9
    assert sum(r.toxic for r in hits) / sum(r.toxic for r in rows) > 0.9
    assert all(0 <= r.expected <= 2 for r in rows)


def test_shared_weights_and_ordered_thresholds():
    rng = np.random.default_rng(0)
    rows, grade = [], []
    for _ in range(600):
        n = int(rng.integers(0, 9))
        rows.append(toxicity.Counter({"bad": n, "the": int(rng.integers(1, 9))}))
        grade.append(0 if n < 2 else 1 if n < 6 else 2)
    model = toxicity.fit_ordinal(rows, np.array(grade), ["bad", "the"])
    assert model.thresholds[0] < model.thresholds[1] and model.weights["bad"] > 1 > abs(model.weights["the"])
    expected = [sum(model.above("bad " * n + "the")) for n in (0, 3, 8)]
    assert expected[0] < 0.5 < expected[1] < 1.5 < expected[2]


def test_odd_and_empty(odd, empty, labels, labelled):
    model = toxicity.train(labelled, labels)
    assert {r.s.grade for r in odd.select(toxicity.severity(model, F.col("text")).alias("s")).collect()} == {0}
    assert empty.select(toxicity.severity(model, F.col("text"))).count() == 0
    none = toxicity.train(empty, labels)
    assert none.above("anything at all")[0] < 0.01
