from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfsift.llm.exact_dedup import exact_dedup

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[(row.text or "").translate(A_Z)].append(row.doc_id)
    best = {t: max(ids, key=lambda i: (i is not None, i or 0)) for t, ids in groups.items()}
    return sorted((str(r.doc_id), best[t], len(groups[t])) for r in rows for t in [(r.text or "").translate(A_Z)])


def found(df):
    return sorted((str(r.doc_id), r.keep_id, r.group_size) for r in df.collect())


def test_odd_rows_over_several_batches(odd):
    df = exact_dedup(odd.repartition(5), files_per_batch=1)
    assert found(df) == expected(odd.collect())
    assert df.filter("kept").count() == df.select("digest").distinct().count()


def test_clashing_digests_are_told_apart_by_full_texts(odd):
    df = exact_dedup(odd, digest=lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1))
    assert found(df) == expected(odd.collect())


def test_repeated_rows_keep_one(spark, odd):
    df = exact_dedup(odd.union(odd))
    assert df.filter("kept").count() == len({(r.text or "").translate(A_Z) for r in odd.collect()})


@pytest.mark.parametrize("small", [True, False])
def test_bytes_are_compared_whether_or_not_the_hits_are_few(odd, monkeypatch, small):
    monkeypatch.setattr("shelfsift.llm.exact_dedup.is_small", lambda df: small)
    assert found(exact_dedup(odd)) == expected(odd.collect())
    short = exact_dedup(odd, digest=lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1))
    assert found(short) == expected(odd.collect())


def test_stores_of_many_partitions_take_little_disk(spark, documents):
    local = Path(spark.sparkContext._jvm.org.apache.spark.util.Utils.getLocalDir(spark.sparkContext._jsc.sc().conf()))

    def used():
        return sum(p.stat().st_blocks * 512 for p in local.parent.rglob("*") if p.is_file())

    parts, before = spark.conf.get("spark.sql.shuffle.partitions"), used()
    spark.conf.set("spark.sql.shuffle.partitions", "211")
    try:
        exact_dedup(documents)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert used() - before < 50 << 20


def test_empty(empty):
    assert exact_dedup(empty).count() == 0
