import hashlib
import re
import zlib
from collections import defaultdict
from functools import partial
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfsift.llm import conversation_repair as repairs
from shelfsift.llm.queries import QUERIES

LEGAL = re.compile(r"(s?(ua)+)?")
WORD, END = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        out.append("b" if not WORD.search(text) else "d" if (role, text) in seen else "" if END.search(text) else "t")
        seen.add((role, text))
    return out


def brute(rows, costs=repairs.Costs()):
    """(cost, audit, repaired turns) by carrying whole audits along: state is the legal text of initials so far."""
    cells = {"": (0, "", ())}

    def inserted(cells):
        todo = list(cells)
        while todo:
            s = todo.pop()
            cost, audit, out = cells[s]
            letter = "a" if s == "u" else "u"
            new = (cost + costs.insert, audit + "I", (*out, (NAMES[letter], "")))
            if letter not in cells or new[:2] < cells[letter][:2]:
                cells[letter] = new
                todo.append(letter)
        return cells

    cells = inserted(cells)
    for (role, text), fault in zip(rows, faults(rows)):
        after = {}
        for s, (cost, audit, out) in cells.items():
            options = [(s, cost + costs.delete, audit + "D", out)]
            if fault not in ("b", "d"):
                more = costs.truncated if fault == "t" else 0
                for letter in {"": "su", "s": "u", "u": "a", "a": "u"}[s]:
                    if role[:1] == letter:
                        options.append((letter, cost + more, audit + "K", (*out, (role, text))))
                    if letter in NAMES:
                        options.append((letter, cost + more + costs.rerole, audit + "R", (*out, (NAMES[letter], text))))
            for to, *cell in options:
                if to not in after or tuple(cell[:2]) < after[to][:2]:
                    after[to] = tuple(cell)
        cells = inserted(after)
    return min(cells[s] for s in ("", "a") if s in cells)


def exhaustive(rows, costs):
    """Every way to edit up to three rows with up to two turns inserted at every place."""
    best = None
    places = ["", "u", "a", "uu", "ua", "au", "aa"]
    kinds = [["D"] if f in ("b", "d") else ["D", "K", "u", "a"] for f in faults(rows)]
    for edits in product(*kinds):
        for inserts in product(places, repeat=len(rows) + 1):
            cost = costs.insert * sum(map(len, inserts))
            audit, initials = "I" * len(inserts[0]), inserts[0]
            for (role, _), fault, edit, more in zip(rows, faults(rows), edits, inserts[1:]):
                cost += {"D": costs.delete, "K": 0}.get(edit, costs.rerole)
                cost += costs.truncated if fault == "t" and edit != "D" else 0
                audit += {"D": "D", "K": "K"}.get(edit, "R") + "I" * len(more)
                initials += ("" if edit == "D" else (role[:1] or "?") if edit == "K" else edit) + more
            if LEGAL.fullmatch(initials) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


row = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["Hi.", "No!", "cut", "", "x?"]))
prices = st.builds(repairs.Costs, st.integers(0, 3), st.integers(0, 3), st.integers(1, 4), st.integers(0, 5))


def codes_of(rows):
    numbers = {"": 0, "b": 1, "d": 2, "t": 3}
    return bytes(4 * ("sua".find(r[:1]) if r[:1] in tuple("sua") else 3) + numbers[f] for (r, _), f in zip(rows, faults(rows)))


def solved(rows, costs):
    found = repairs.solve(codes_of(rows), 0, costs)
    return min(found[s] for s in (0, 3) if found[s])


@settings(max_examples=60, deadline=None)
@given(st.lists(row, max_size=2), prices)
def test_brute_force_equals_every_way(rows, costs):
    assert brute(rows, costs)[:2] == exhaustive(rows, costs)


@settings(max_examples=300, deadline=None)
@given(st.lists(row, max_size=30), prices)
def test_audits_equal_brute_force(rows, costs):
    assert solved(rows, costs) == brute(rows, costs)[:2]


@settings(max_examples=100, deadline=None)
@given(st.lists(row, max_size=20), prices)
def test_colliding_hashes_do_no_harm(rows, costs):
    wanted = brute(rows, costs)[:2]
    before = repairs.History.rolled
    repairs.History.rolled = lambda self, h, piece: 0
    try:
        assert solved(rows, costs) == wanted
    finally:
        repairs.History.rolled = before


@given(st.lists(st.sampled_from("ab"), max_size=40), st.lists(st.sampled_from("ab"), max_size=40), st.integers(0, 40))
def test_common_prefix(left, right, shared):
    history, trunk = repairs.History(), 0
    for piece in left[:shared]:
        trunk = history.add(trunk, piece)
    a = b = trunk
    for piece in left[shared:]:
        a = history.add(a, piece)
    for piece in right:
        b = history.add(b, piece)
    one, two = "".join(left), "".join(left[:shared] + right)
    n = next((i for i, (x, y) in enumerate(zip(one, two)) if x != y), min(len(one), len(two)))
    assert history.common(a, b) == n and history.less(a, b) == (one < two)


def damaged(rows):
    out = defaultdict(list)
    for i, (conv, turn, role, text) in enumerate(rows):
        name, at = (" " if v is None else str(v) for v in (conv, turn))
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{name}:{at}".encode()) % 20
        own = out[conv]
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(turn, i, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def expected(rows):
    out = {}
    for conv, own in damaged(rows).items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        pairs = [r[2:] for r in own]
        known = [r[0] for r in own if r[0] is not None]
        found = faults(pairs)
        cost, audit, repaired = brute(pairs)
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, *(found.count(f) for f in "bdt"),
                     illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string"
LONG = [(5, t, ["user", "assistant", "system", "tool"][t * 7 % 11 % 4], f"{['Yes.', 'cut', ''][t * t % 3]}{t % 9}{'.' * (t % 2)}")
        for t in range(1500)]
ODD = [
    (1, None, "user", "Hello there."), (1, 0, None, "What?"), (1, 1, "assistant", None), (1, 1, "assistant", "Twice."),
    (None, 3, "user", "No conversation!"), (None, 4, "assistant", "Fine."), (None, None, None, None),
    (2, None, "user", "A."), (2, None, "assistant", "B."), (3, 2**60, "user", "word " * 50_000 + "."),
    (3, -5, "système", "é.\n"), (3, 2**60 + 1, "Assistant", "x\x85"), (4, 7, "user", ""), (4, 7, "user", ""),
    *[(6, 1, "user", "Same.")] * 50, *[(7, t, "user" if t % 2 else "assistant", "Same.") for t in range(40)], *LONG]


@pytest.fixture(scope="module")
def tables(spark, folder):
    given_rows = spark.read.parquet(f"{folder}/conversations.parquet")
    odd = spark.createDataFrame(ODD, SCHEMA)
    return {"given": given_rows, "odd": odd.coalesce(1), "repeated": odd.union(odd).coalesce(1),
            "clashing": odd.selectExpr("*", "text AS conv", "turn AS place", "role AS copy", "turn AS kind", "text AS digest")
            .coalesce(1), "empty": spark.createDataFrame([], SCHEMA)}


@pytest.mark.parametrize("name", ["given", "odd", "repeated", "clashing", "empty"])
@pytest.mark.parametrize("bits", [12, 5])
def test_query_equals_brute_force(spark, tables, tmp_path, monkeypatch, name, bits):
    monkeypatch.setattr(repairs, "repair", partial(repairs.repair, segment_bits=bits))
    tables[name].write.parquet(str(tmp_path / "conversations.parquet"))
    rows = spark.read.parquet(str(tmp_path / "conversations.parquet")).select("conv_id", "turn", "role", "text").collect()
    found = QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == expected(rows) and len(found) == len({r[0] for r in rows})


@pytest.mark.parametrize("bits", [12, 4])
def test_repaired_turns_are_legal_and_as_brute_force_has_them(spark, bits):
    rows = [r for r in ODD if r[0] in (5, 6, 7, 2)]
    found = repairs.repair(spark.createDataFrame(rows, SCHEMA).coalesce(1), costs=repairs.Costs(insert=1), segment_bits=bits)
    out = defaultdict(list)
    for r in sorted(repairs.turns(found).collect(), key=lambda r: (r.conv, r.place, r.nth)):
        out[r.conv].append((r.role, r.text))
    for conv in (2, 5, 6, 7):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        assert out[conv] == list(brute([r[2:] for r in own], repairs.Costs(insert=1))[2])
        assert LEGAL.fullmatch("".join(role[0] for role, _ in out[conv]))
