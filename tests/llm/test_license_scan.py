import re

import pytest

from shelfsift.llm import license_scan
from shelfsift.llm.common import LOWER, UPPER

A_Z = str.maketrans(UPPER, LOWER)
TEXTS = [
    (1, "The MIT License, the MIT-license and CC BY. mit\nlicense gnu general public license"),
    (2, "gnu general public licenses; gnu general gnu general public license cc by cc by"),
    (3, "émit license mit licenseé İmit license K"),
    (4, "Intro. " + license_scan.NOTICES["mit"].replace("merge publish", "merge swiftly publish").replace("without limitation ", "") + " end"),
    (5, "of this software and the rights to use"),
    (6, license_scan.NOTICES["bsd"].upper()),
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_Z))
    places = []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    starts = [i for i, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(places), min(starts, default=None), max(starts, default=None), labels


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def test_base(documents, odd, texts):
    for docs in (documents, odd, texts):
        found = license_scan.scan(docs).collect()
        assert {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found} == {
            r.doc_id: brute(r.text) for r in docs.collect()}
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in found)


def test_notices_survive_edits_and_stray_words_do_not_make_one(texts):
    labels = {r.doc_id: r.labels for r in license_scan.scan(texts).collect()}
    assert labels[4] == "mit" and labels[5] == "" and labels[6] == "bsd"


def test_repeated_rows_and_empty(odd, empty):
    assert license_scan.scan(odd.union(odd)).count() == 2 * odd.count()
    assert license_scan.scan(empty).count() == 0
