import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfsift.llm import token_files
from shelfsift.session import scratch_path
from tests.llm.test_packing import PATH, ids_of


def coder(size=50, seed=0, bits=12):
    counts = np.random.default_rng(seed).zipf(1.3, size).clip(max=10**9) - 1
    return token_files.Coder(token_files.quantised(counts, bits), bits)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 49), max_size=600), st.integers(1, 9), st.integers(1, 5), st.data())
def test_block_round_trip_from_every_checkpoint(ids, lanes, every, data):
    c = coder()
    ids = np.array(ids, np.int64)
    block = c.encode(ids, [["a", len(ids)]], lanes, every)
    found, table = c.decode(block, every=every)
    assert found.tolist() == ids.tolist() and table == [["a", len(ids)]]
    first = data.draw(st.integers(0, len(ids)))
    last = data.draw(st.integers(first, len(ids)))
    assert c.decode(block, first, last, every)[0].tolist() == ids[first:last].tolist()


def test_long_block_is_near_its_entropy():
    c = coder(bits=20)
    p = c.shares / c.shares.sum()
    ids = np.random.default_rng(1).choice(50, 300_000, p=p.astype(float))
    block = c.encode(ids, [])
    assert c.decode(block)[0].tolist() == ids.tolist()
    entropy = -(p * np.log2(p)).sum() * len(ids) / 8
    states = 8 * token_files.LANES * 3
    assert len(block) < 1.01 * entropy + states + 200


def test_damage_is_noticed():
    c = coder()
    block = bytearray(c.encode(np.arange(50), [["1", 50]]))
    block[-1] ^= 1
    with pytest.raises(ValueError):
        c.decode(bytes(block))
    table = bytearray(c.to_bytes())
    table[-1] ^= 1
    with pytest.raises(ValueError):
        token_files.Coder.from_bytes(bytes(table))


@given(st.lists(st.integers(0, 10**12), min_size=1, max_size=64))
def test_shares_fill_the_table(counts):
    shares = token_files.quantised(np.array(counts), 12)
    assert shares.sum() == 1 << 12 and shares.min() >= 1


@pytest.mark.parametrize("block", [token_files.BLOCK, 500])
def test_files_hold_all_ids_in_order(spark, documents, odd, block):
    clashing = odd.selectExpr("doc_id", "text", "digest AS ids", "digest AS part", "digest AS key", "digest AS uid")
    for docs in (documents, clashing, odd.union(odd)):
        folder = scratch_path(spark, "token-files")
        token_files.write(docs, PATH, folder, block=block)
        rows = sorted(token_files.read(spark, folder).collect(), key=lambda r: r.start)
        assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
        order = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
        assert order == sorted(order)
        wanted = Counter((r.doc_id, np.array(ids_of(r.text), "<u4").tobytes()) for r in docs.collect())
        assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == wanted
        line = b"".join(bytes(r.ids) for r in rows)
        first, last = len(line) // 12, len(line) // 6
        pieces = sorted(token_files.read_span(spark, folder, first, last).collect())
        assert b"".join(bytes(p.ids) for p in pieces) == line[4 * first:4 * last]


def test_query_equals_a_direct_computation(spark, documents, folder):
    from shelfsift.llm.queries import QUERIES

    start, wanted = 0, []
    for r in sorted(documents.collect(), key=lambda r: r.doc_id):
        ids = np.array(ids_of(r.text), "<u4")
        wanted.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op12_token_files"](spark, folder).collect())) == wanted


def test_empty(spark, empty):
    folder = scratch_path(spark, "token-files")
    token_files.write(empty, PATH, folder)
    assert token_files.read(spark, folder).count() == 0
