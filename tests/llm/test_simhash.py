import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from shelfsift.llm import simhash
from shelfsift.llm.common import LOWER, UPPER


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = Counter()
    for gram in grams:
        h = xxhash.xxh64(gram.encode(), seed=42).intdigest()
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(grams))


def brute_components(prints, radius=2):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    distinct = list(root)
    for i, p in enumerate(distinct):
        for q in distinct[:i]:
            if (p ^ q).bit_count() <= radius:
                a, b = sorted((find(p), find(q)))
                root[b] = a
    return {p: find(p) for p in distinct}


def check(rows, texts):
    prints = {i: brute_print(t) for i, t in texts}
    groups = brute_components(list(prints.values()))
    assert {r.doc_id: int(r.f, 16) for r in rows} == prints
    lowest = {}
    for i, p in prints.items():
        if i is not None:
            lowest[groups[p]] = min(i, lowest.get(groups[p], i))
    assert all(r.component == lowest.get(groups[prints[r.doc_id]]) for r in rows)


def test_documents_and_odd_rows(documents, odd):
    for docs in (documents, odd):
        found = simhash.near_dedup(docs, ["doc_id"]).withColumn("f", simhash.hexadecimal(F.col("fp")))
        check(found.collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_chains_and_dense_groups(spark):
    rng = np.random.default_rng(3)
    prints = set()
    for base in rng.integers(0, 2**63, 20).tolist():
        prints.add(base)
        for _ in range(60):
            base ^= (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64)))
            prints.add(base)
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    links = simhash.links(spark.createDataFrame(signed, "fp long"))
    roots = {r.node % 2**64: r.root % 2**64 for r in simhash.components(links).collect()}
    groups = brute_components(list(prints))
    together = {}
    for p in prints:
        assert together.setdefault(roots.get(p, p), groups[p]) == groups[p]
    assert len(together) == len(set(groups.values()))


def test_blocks_of_a_tile_are_all_compared(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 3)
    prints = [(1 << i) | (1 << j) for i in range(16) for j in range(i)]
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    assert simhash.components(links).select("root").distinct().count() == 1


def test_empty(empty):
    assert simhash.near_dedup(empty, ["doc_id"]).count() == 0
