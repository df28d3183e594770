from hashlib import sha256

from hypothesis import given
from hypothesis import strategies as st

from shelfsift.llm import merkle


def brute(rows):
    rows = sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    out = {}
    for r, after in zip(rows, rows[1:] + rows[:1]):
        text, following = r.text or "", after.text or ""
        q = len(text) // 4
        changed = text[:len(text) - q] + following[:q]
        a, b, c = map(merkle.tree, (text, changed, following))
        out[r.doc_id] = (len(text), sha256(changed.encode()).hexdigest(), merkle.to_text(a), merkle.to_text(b),
                         merkle.likeness(a, b), merkle.likeness(a, c))
    return out


def test_documents_and_odd_rows(documents, odd):
    for docs in (documents, odd, odd.limit(1)):
        rows = merkle.fingerprints(docs).collect()
        assert {r[0]: tuple(r)[1:] for r in rows} == brute(docs.collect())
        assert len(rows) == docs.count()


def test_edits_keep_most_and_strangers_little(documents):
    rows = merkle.fingerprints(documents.filter("n_chars > 400")).collect()
    assert sum(r.near_edited for r in rows) / len(rows) > 0.6
    assert sum(r.near_next for r in rows) / len(rows) < 0.2


def test_empty(empty):
    assert merkle.fingerprints(empty).count() == 0


texts = st.text(st.sampled_from("ab.! \né"), max_size=300)


@given(texts, texts)
def test_trees(a, b):
    one, two = merkle.tree(a), merkle.tree(b)
    assert (merkle.from_text(merkle.to_text(one)) == one) and one[1] == len(a)
    assert (one[0] == two[0]) == (a == b)
    assert 0 <= merkle.likeness(one, two) == merkle.likeness(two, one) <= 1
    assert (merkle.edits(one, two) == []) or a != b


def test_differing_branches_locate_the_edit():
    parts = [f"Sentence number {i} of the text. And one more of it.\n" for i in range(40)]
    a = "".join(parts)
    b = a.replace("number 17", "NUMBER 17")
    (start, end), = merkle.edits(merkle.tree(a), merkle.tree(b))
    assert "number 17" in a[start:end] and end - start < 60
    assert merkle.likeness(merkle.tree(a), merkle.tree(b)) > 0.95
