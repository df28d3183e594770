"""Every stage of the corpus pipeline against a direct computation over its own input."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfsift.llm import mixing, toxicity
from shelfsift.llm.common import LOWER, UPPER
from tests.llm.test_mixing import filled
from tests.llm.test_packing import ids_of
from tests.llm.test_simhash import brute_components, brute_print


def key(row):
    """A row as something that can be counted and ordered, nulls included."""
    return tuple((v is not None, str(v)) for v in row)


def first(rows):
    """The row with the smallest doc_id, a null one only if there is no other."""
    return min(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0))


def without_toxic(rows, model):
    return [r for r in rows if model.above(r.text)[0] < 0.5]


def without_copies(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(str.maketrans(UPPER, LOWER))].append(r)
    return [max(group, key=lambda r: (r.doc_id is not None, r.doc_id or 0)) for group in groups.values()]


def without_near_copies(rows):
    prints = [brute_print(r.text) for r in rows]
    roots, groups = brute_components(prints), defaultdict(list)
    for r, p in zip(rows, prints):
        groups[roots[p]].append(r)
    return [first(group) for group in groups.values()]


def mixed(rows):
    sizes, by_source = defaultdict(int), defaultdict(list)
    for r in rows:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        sizes[r.source] += size
        name = "" if r.doc_id is None else str(r.doc_id)
        by_source[r.source].append((hashlib.md5(f"7:{name}".encode()).hexdigest(), size, r))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = filled(dict(sizes), {s: i % 3 + 1 for i, s in enumerate(order)})
    out = []
    for source, own in by_source.items():
        goal = int(target[source] + 0.5)
        whole = goal // sizes[source] if sizes[source] else 0
        left = goal - whole * sizes[source]
        for _, size, r in sorted(own, key=lambda entry: entry[:2]):
            out += [r] * (whole + (left > 0 and 2 * max(0, min(left, size)) >= size))
            left -= size
    return out


def packed_ids(rows):
    found = defaultdict(Counter)
    for r in rows:
        found[r.doc_id].update(ids_of(r.text))
    return found


def compare(spark, docs, folder):
    """Runs the stages one by one, each over what the one before it kept, as run() does."""
    rows, seen = docs.collect(), []
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    wanted = [lambda r: without_toxic(r, model), without_copies, without_near_copies, mixed]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, wanted):
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns
        docs = corpus_pipeline.stored(kept, "pipeline-test")
        expected, rows = brute(rows), docs.collect()
        assert Counter(map(key, rows)) == Counter(map(key, expected)), name
        seen.append(len(rows))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    ids, spans = defaultdict(Counter), defaultdict(list)
    for p in pieces:
        ids[p.doc_id].update(np.frombuffer(p.ids, "<u4").tolist())
        spans[p.sequence_id].append((p.offset, p.length))
    assert ids == packed_ids(rows)
    for parts in spans.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
        assert sum(n for _, n in parts) <= 4096
    return seen, len(pieces)


def test_stages_over_documents(spark, documents, folder):
    seen, _ = compare(spark, documents, folder)
    assert documents.count() > seen[0] > seen[1] >= seen[2] > 0


def test_clean_documents_stay_and_toxic_ones_go(spark, folder):
    """On the table of 10,000 documents; the smallest has 11 labelled toxic rows, too few to learn their words from."""
    folder = f"{folder.rsplit('/', 1)[0]}/sf0.1"
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, documents, folder).select("doc_id").collect()}
    clean = [i for i, toxic in labels.items() if not toxic]
    toxic = [i for i, toxic in labels.items() if toxic]
    assert sum(i in kept for i in clean) > 0.97 * len(clean)
    assert sum(i not in kept for i in toxic) > 0.8 * len(toxic)


def test_odd_rows_and_repeats(spark, odd, folder):
    compare(spark, odd, folder)
    compare(spark, odd.union(odd), folder)


@pytest.mark.parametrize("kind", ["documents", "empty"])
def test_run(spark, documents, empty, folder, tmp_path, kind):
    source = {"documents": documents, "empty": empty}[kind]
    source.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert (found.count() > 0) == (kind == "documents")


def test_mixing_stage_of_a_billion_words(spark, monkeypatch):
    """Totals and weights are ints, their product need not be one."""
    monkeypatch.setattr(mixing, "word_count", lambda text: F.lit(400_000_000).cast("long"))
    docs = spark.createDataFrame([(i, f"text {i}", "abc"[i], "en", 6) for i in range(3)], "doc_id long, text string, source string, lang string, n_chars long")
    rows = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 2]
