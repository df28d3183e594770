import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from shelfsift.llm import fill_middle

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
texts = st.text(st.sampled_from("aB. \n\té東\U0001F600\x85\xa0<P>SM")) | st.text(st.characters(exclude_categories=["Cs"]))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text, unit):
    text = text or ""
    units = TOKENS.findall(text) if unit == "token" else list(text)
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 80:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit", ["token", "character"])
def test_documents_and_odd_rows(spark, documents, odd, unit):
    marked = spark.createDataFrame(
        [(i, t, "a", 0.0) for i, t in enumerate(["<P>", "x <S> y", "a<M", "<P <S <", "<", "P>", "é" * 9000] * 9)],
        odd.schema)
    for docs in (documents, odd, odd.union(odd), marked):
        found = fill_middle.rearrange(docs, unit=unit)
        rows = found.withColumn("again", fill_middle.restored(found.output, found.form)).collect()
        wanted = sorted((brute(r.doc_id, r.text, unit) + (r.text or "",) for r in docs.collect()), key=repr)
        assert sorted((tuple(r)[1:] for r in rows), key=repr) == wanted


def test_extra_columns_with_names_used_inside(spark):
    docs = spark.createDataFrame([(1, "one two", "x", 3, 4, "f", 5)], "doc_id long, text string, key string, h1 long, "
                                                                    "data long, form string, n long")
    assert tuple(fill_middle.rearrange(docs).first()) == (1, *brute(1, "one two", "token"))


@given(texts)
def test_index_converts_every_place(text):
    data = text.encode()
    index = fill_middle.SparseIndex(data)
    places = list(range(len(text) + 1))
    in_bytes = [len(text[:i].encode()) for i in places]
    assert len(index) == len(text) and len(index.characters) == sum(ord(c) > 127 for c in text)
    assert index.to_bytes(places).tolist() == in_bytes
    assert index.to_characters(in_bytes).tolist() == places


@given(texts)
def test_token_ends(text):
    ends, at = [], 0
    for token in TOKENS.findall(text):
        at += len(token.encode())
        ends.append(at)
    assert fill_middle.token_ends(text.encode()).tolist() == ends


def test_empty(empty):
    assert fill_middle.rearrange(empty).count() == 0
