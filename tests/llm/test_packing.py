from collections import defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfsift.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=200, deadline=None)
@given(st.text() | st.text(st.sampled_from("aB \n\t'́\xa0 İΣsdl1.<|endoftext>")) | st.just("a<|endoftext|>b"))
def test_word_by_word_equals_the_whole(text):
    encode = packing.WordIds(PATH)
    assert np.frombuffer(encode(text), encode.kind).tolist() == ids_of(text)


def test_pieces_and_forgotten_stems(documents, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 200)
    monkeypatch.setattr(packing, "PIECE", 10_000)
    encode = packing.WordIds(PATH)
    texts = [r.text for r in documents.collect()] + [None, "", " ", "\n"] + [r.text for r in documents.collect()]
    for text, found in zip(texts, encode.many(texts), strict=True):
        assert np.frombuffer(found, encode.kind).tolist() == ids_of(text)


def test_a_tokenizer_that_keeps_white_space_takes_whole_texts(documents):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, whole = packing.WordIds(path), Tokenizer.from_file(path)
    assert not encode.by_words
    for r in documents.limit(50).collect():
        assert np.frombuffer(encode(r.text), encode.kind).tolist() == whole.encode(r.text or "").ids + [2]


@pytest.mark.parametrize("length", [4096, 64])
def test_round_trip(documents, odd, length):
    for docs in (documents, odd, odd.union(odd)):
        texts = defaultdict(list)
        for r in docs.collect():
            texts[r.doc_id].append(ids_of(r.text))
        pieces = packing.pack(docs, ["doc_id"], PATH, length).collect()
        found, spans = defaultdict(list), defaultdict(list)
        for p in pieces:
            ids = np.frombuffer(p.ids, "<u4")
            assert len(ids) == p.length and p.offset + p.length <= length
            found[p.doc_id].append((p.start, ids.tolist(), p.doc_tokens))
            spans[p.sequence_id].append((p.offset, p.length))
        for name, own in texts.items():
            assert sum(len(ids) for _, ids, _ in found[name]) == sum(map(len, own))
            if len(own) == 1:
                assert [i for _, ids, _ in sorted(found[name]) for i in ids] == own[0]
                assert {n for *_, n in found[name]} == {len(own[0])}
        for name, parts in spans.items():
            at = 0
            for offset, size in sorted(parts):
                assert offset == at
                at += size
            assert at == length or name == max(spans)


def test_hilbert_curve_is_a_path():
    cells = np.array(list(product(range(8), repeat=3)))
    keys = packing.hilbert(cells, 3)
    assert sorted(keys) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_like_documents_are_neighbours(spark):
    rows = [(i, ("red apple pie " if i % 2 else "steel bolt nut ") * 30 + f"word{i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = sorted(packing.pack(docs, ["doc_id"], PATH).collect(), key=lambda p: (p.sequence_id, p.offset))
    kinds = [p.doc_id % 2 for p in pieces]
    assert sum(a != b for a, b in zip(kinds, kinds[1:])) < 20


def test_empty(empty):
    assert packing.pack(empty, ["doc_id"], PATH).count() == 0
