"""Conversation structure repair: the cheapest edits by a persistent audit DP.

A conversation must read ``(s?(ua)+)?`` by the initials of its roles. Turns are kept (K), given the role of user or
assistant (R) or deleted (D), and empty turns inserted (I); an audit is the string of these initials, one per edit.

The DP holds the cheapest audit per state of the pattern. Audits share their prefixes as linked nodes, and a tie
is settled at the first edit that differs, which ancestors at powers of two and rolling hashes find without spelling
the audits out. Every claim that hashes make is verified edit by edit up to a node that both audits share.

Rows are dealt out by range and cut into segments of at most 2^SEGMENT_BITS rows. A segment is solved for every state in which
it may be entered and left; the segments of a conversation are then joined in order, again over shared nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.common import located, map_frames, stored

#: States: nothing yet, after the system turn, after a user's, after an assistant's; the first and the last may end.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
ROLES = ("user", "user", "assistant", "user")  # what a state asks for next
#: A segment takes 2^SEGMENT_BITS places at most; audits of up to SHORT rows are remembered, REMEMBERED of them.
SEGMENT_BITS, SHORT, REMEMBERED = 12, 24, 20_000
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


class Costs(NamedTuple):
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class History:
    """Audits as linked nodes: a node is the audit of its parent and one further edit (or piece of an audit)."""

    BASE, PRIME = 1_000_003, (1 << 61) - 1

    def __init__(self):
        self.piece, self.hash, self.depth, self.up = [""], [0], [0], [[]]

    def add(self, node: int, piece: str) -> int:
        ancestors = [node]
        while len(ancestors) <= len(self.up[ancestors[-1]]):
            ancestors.append(self.up[ancestors[-1]][len(ancestors) - 1])
        self.up.append(ancestors)
        self.piece.append(piece)
        self.hash.append(self.rolled(self.hash[node], piece))
        self.depth.append(self.depth[node] + 1)
        return len(self.piece) - 1

    def rolled(self, before: int, piece: str) -> int:
        return (before * self.BASE + hash(piece)) % self.PRIME

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            node = self.up[node][(self.depth[node] - depth).bit_length() - 1]
        return node

    def pieces(self, node: int, depth: int = 0) -> list[str]:
        """Pieces of the audit beyond its first ``depth``."""
        found = []
        while self.depth[node] > depth:
            found.append(self.piece[node])
            node = self.up[node][0]
        return found[::-1]

    def _difference(self, a: int, b: int) -> int:
        """Depth before the last difference of two nodes of one depth up to a node that both share, or -1."""
        while a != b:
            if self.piece[a] != self.piece[b]:
                return self.depth[a] - 1
            a, b = self.up[a][0], self.up[b][0]
        return -1

    def common(self, a: int, b: int) -> int:
        """Number of leading pieces that two audits have in common."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, depth), self.ancestor(b, depth)
        if self.hash[x] != self.hash[y]:
            for k in range(len(self.up[x]) - 1, -1, -1):
                if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                    x, y = self.up[x][k], self.up[y][k]
            x, y = self.up[x][0], self.up[y][0]
        found = self.depth[x]
        while (earlier := self._difference(x, y)) >= 0:  # the hashes agreed by chance
            found = earlier
            x, y = self.ancestor(x, found), self.ancestor(y, found)
        return found

    def less(self, a: int, b: int) -> bool:
        """Whether the first audit comes before the second one, by its letters."""
        shared = self.common(a, b)
        return "".join(self.pieces(a, shared)) < "".join(self.pieces(b, shared))


Cell = tuple[int, int] | None


def _offer(cells: list[Cell], state: int, cost: int, history: History, node: int, piece: str) -> bool:
    """Puts a continued audit into its state's cell if it is cheaper, or as cheap and before the one there."""
    held = cells[state]
    if held is not None and cost > held[0]:
        return False
    new = history.add(node, piece)
    if held is not None and cost == held[0] and not history.less(new, held[1]):
        return False
    cells[state] = (cost, new)
    return True


def _insert(cells: list[Cell], costs: Costs, history: History) -> None:
    """Offers inserted turns from every state until none is worth while."""
    more = True
    while more:
        more = False
        for state in range(4):
            if cells[state] is not None:
                cost, node = cells[state]
                after = NEXT[state]["a" if state == 2 else "u"]
                more |= _offer(cells, after, cost + costs.insert, history, node, "I")


def _turn(cells: list[Cell], initial: str, fault: int, costs: Costs, history: History) -> list[Cell]:
    """Cells after one more row."""
    out: list[Cell] = [None] * 4
    for state, cell in enumerate(cells):
        if cell is None:
            continue
        cost, node = cell
        _offer(out, state, cost + costs.delete, history, node, "D")
        if fault in (BLANK, DUPLICATE):
            continue
        cost += costs.truncated if fault == TRUNCATED else 0
        for letter, after in NEXT[state].items():
            if letter == initial:
                _offer(out, after, cost, history, node, "K")
            elif letter != "s":
                _offer(out, after, cost + costs.rerole, history, node, "R")
    _insert(out, costs, history)
    return out


def solve(codes: bytes, entry: int, costs: Costs) -> list[tuple[int, str] | None]:
    """Cheapest (cost, audit) of the rows for each state in which they may be left; see ``code`` for the rows' bytes."""
    history = History()
    cells: list[Cell] = [None] * 4
    cells[entry] = (0, 0)
    _insert(cells, costs, history)
    for c in codes:
        cells = _turn(cells, "sua."[c >> 2], c & 3, costs, history)
    return [cell and (cell[0], "".join(history.pieces(cell[1]))) for cell in cells]


_remembered = lru_cache(REMEMBERED)(solve)


def code(role: Column, text: Column) -> Column:
    """Initial of the role (s, u, a, another: 0 to 3) times 4, plus the row's fault; duplicates aren't told here."""
    initial = F.substring(role, 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    whole = text.rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return number * 4 + F.when(blank, BLANK).when(whole, FINE).otherwise(TRUNCATED)


class Repair(NamedTuple):
    #: conv, place, role, text: the rows as they came, in order of their places.
    rows: DataFrame
    #: conv, place (of its first row), entry (state), edits: the chosen audit of every segment.
    segments: DataFrame
    #: conv, gaps, blank, duplicate, truncated, illegal, cost, audit: a row per conversation.
    conversations: DataFrame
    segment_bits: int


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    costs: Costs = Costs(), segment_bits: int = SEGMENT_BITS,
) -> Repair:
    """The cheapest edits of every conversation.

    Rows stand by ``turn``, null turns first; rows of one turn as in the table's files. Each row counts for its first
    fault only: blank, duplicate (role and text seen earlier in the conversation) or truncated (the last character that
    isn't white space is none of ``.!?``). Null roles and texts count as empty ones, a null ``conv`` is a conversation
    like others, and repeated rows are turns of their own. Very long texts are read by column functions only. Rows are dealt out by range and their texts never gathered, so a conversation may
    hold any share of them; its audit, a byte per row, is one value and joined in one task. An empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    if costs.insert < 1:
        raise ValueError("an inserted turn must cost something")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = located(rows).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), "__file", "__row")
    by = ["conv", "turn", "__file", "__row"]
    dealt = stored(
        named.repartitionByRange(parts, *by).sortWithinPartitions(*by)
        .select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("place")), "repair-rows")

    coded = dealt.select(
        "conv", "place", F.struct("place", code(F.col("role"), F.col("text")).alias("code"), "turn").alias("row"),
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"))
    firsts = coded.groupBy("conv", "digest").agg(F.min("place").alias("place"))
    both = coded.select("conv", "place", "row").unionByName(firsts.select("conv", "place"), allowMissingColumns=True)
    both = both.withColumn("first", F.when(F.col("row").isNull(), F.col("place")))
    segments = both.groupBy("conv", F.shiftright("place", segment_bits).alias("segment")).agg(
        F.sort_array(F.collect_list("row")).alias("rows"), F.collect_list("first").alias("firsts"))
    segments = segments.select(
        "conv", F.transform("rows", lambda r: r["place"]).alias("places"),
        F.transform("rows", lambda r: r["code"]).alias("codes"), "firsts",
        F.array_min(F.transform("rows", lambda r: r["turn"])).cast("string").alias("low"),
        F.array_max(F.transform("rows", lambda r: r["turn"])).cast("string").alias("high"),
        F.size(F.array_distinct(F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull()))).alias("turns"))
    solved = map_frames(
        segments, ["conv"], lambda frames: _solved(frames, costs, segment_bits),
        "place long, codes binary, costs array<long>, audits array<string>, low string, high string, turns long")
    chosen = map_frames(
        solved.repartition(parts, "conv").sortWithinPartitions("conv", "place"), ["conv"], _chosen,
        "place long, entry int, edits string, stats array<long>, audit string")
    chosen = stored(chosen, "repair-audits")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    conversations = chosen.filter(F.col("audit").isNotNull()).select(
        "conv", *(F.col("stats")[i].alias(name) for i, name in enumerate(names)), "audit")
    return Repair(dealt.drop("turn"), chosen.select("conv", "place", "entry", "edits"), conversations, segment_bits)


def _solved(frames: Iterator[pd.DataFrame], costs: Costs, segment_bits: int) -> Iterator[pd.DataFrame]:
    """The cheapest audits of every segment, for the states it may be entered in.

    A conversation's rows stand in successive places, so one that doesn't start where a segment does starts there.
    """
    for f in frames:
        out = []
        for name, places, codes, firsts, *turns in zip(
                f["conv"], f["places"], f["codes"], f["firsts"], f["low"], f["high"], f["turns"]):
            codes = np.asarray(codes, np.uint8)
            again = ~np.isin(places, firsts) & ((codes & 3) != BLANK)
            codes = np.where(again, (codes & 12) | DUPLICATE, codes).astype(np.uint8).tobytes()
            place = int(places[0])
            find = _remembered if len(codes) <= SHORT else solve
            entries = range(4) if place % (1 << segment_bits) == 0 else (0,)
            found = [cell or (None, None) for entry in entries for cell in find(codes, entry, costs)]
            spent, audits = zip(*found)
            out.append((name, place, codes, list(spent), list(audits), *turns))
        yield pd.DataFrame(out, columns=["conv", "place", "codes", "costs", "audits", "low", "high", "turns"])


class _Joined:
    """The segments of one conversation, in order."""

    def __init__(self, conv):
        self.conv, self.history = conv, History()
        self.cells: list[Cell] = [(0, 0), None, None, None]
        self.state = {0: 0}
        self.places: list[int] = []
        self.faults = np.zeros(4, np.int64)
        self.illegal, self.last = 0, None
        self.low, self.high, self.turns = None, None, 0

    def add(self, place, codes, spent, audits, low, high, turns) -> None:
        self.places.append(place)
        initials = [c >> 2 for c in codes]
        before = [] if self.last is None else [self.last]
        self.illegal += sum(pair not in ((0, 1), (1, 2), (2, 1)) for pair in zip(before + initials, (before + initials)[1:]))
        self.last = initials[-1]
        self.faults += np.bincount(np.frombuffer(codes, np.uint8) & 3, minlength=4)
        if low is not None:
            low, high = int(low), int(high)
            self.turns += int(turns) - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high
        cells: list[Cell] = [None] * 4
        for entry, cell in enumerate(self.cells):
            if cell is None or 4 * entry >= len(spent):
                continue
            for state in range(4):
                more, audit = spent[4 * entry + state], audits[4 * entry + state]
                if audit is not None and _offer(cells, state, cell[0] + int(more), self.history, cell[1], audit):
                    self.state[cells[state][1]] = state
        self.cells = cells

    def rows(self) -> list[tuple]:
        """A row per segment; the first one also carries the conversation's figures and whole audit."""
        ends = [self.cells[state] for state in ENDS if self.cells[state] is not None]
        cost, node = ends[0]
        for other in ends[1:]:
            if other[0] < cost or (other[0] == cost and self.history.less(other[1], node)):
                cost, node = other
        path = [self.history.ancestor(node, i) for i in range(len(self.places) + 1)]
        pieces = [self.history.piece[n] for n in path[1:]]
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        stats = [gaps, *self.faults[1:].tolist(), self.illegal, cost]
        return [
            (self.conv, place, self.state[n], piece, stats if i == 0 else None, "".join(pieces) if i == 0 else None)
            for i, (place, n, piece) in enumerate(zip(self.places, path, pieces))
        ]


def _chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Joins the segments of every conversation, which come in order."""
    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["conv", "place", "entry", "edits", "stats", "audit"])

    held = None
    for f in frames:
        out = []
        for conv, *segment in zip(*(f[c] for c in ("conv", "place", "codes", "costs", "audits", "low", "high", "turns"))):
            if held is None or held.conv != conv:
                out += held.rows() if held else []
                held = _Joined(conv)
            held.add(*segment)
        yield frame(out)
    if held:
        yield frame(held.rows())


def _edited(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(conv, place, role, text) of repaired turns, from segments' audits each followed by its rows."""
    conv, place, state, edits = None, 0, 0, iter("")

    def turns(row: tuple[str, str] | None) -> Iterator[tuple]:
        """Inserted turns up to the next row's edit, then that row unless it is deleted; without a row those at the end."""
        nonlocal state
        for edit in edits:
            if edit == "D":
                return
            role, text = (ROLES[state], "") if edit == "I" else row if edit == "K" else (ROLES[state], row[1])
            state = NEXT[state][role[0]]
            yield conv, place, role, text
            if edit != "I":
                return

    for f in frames:
        columns = (f[c] for c in ("conv", "place", "entry", "role", "text"))
        for name, at, entry, role, text in zip(*columns):
            if entry >= 0:
                yield from turns(None)
                conv, place, state, edits = name, at, entry, iter(text)
            else:
                place = at
                yield from turns((role, text))
    yield from turns(None)


def _merged(found: Repair) -> DataFrame:
    """Segments' audits as rows before those of the rows they speak of."""
    audits = found.segments.select("conv", "place", "entry", F.lit("").alias("role"), F.col("edits").alias("text"))
    return found.rows.select("conv", "place", F.lit(-1).alias("entry"), "role", "text").unionByName(audits)


def turns(found: Repair) -> DataFrame:
    """Repaired turns: conv, place (of the row they came from or follow), nth at that place, role, text.

    Segments are worked on apart from each other, so a conversation of any length is spread over tasks.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, last, nth = [], None, 0
        for conv, place, role, text in _edited(frames):
            nth = nth + 1 if last == (conv, place) else 0
            last = (conv, place)
            out.append((conv, place, nth, role, text))
            if len(out) == 1000:
                yield pd.DataFrame(out, columns=["conv", "place", "nth", "role", "text"])
                out = []
        yield pd.DataFrame(out, columns=["conv", "place", "nth", "role", "text"])

    rows = _merged(found).withColumn("segment", F.shiftright("place", found.segment_bits))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "conv", "segment").sortWithinPartitions(
        "conv", "place", F.col("entry").desc()).drop("segment")
    return map_frames(rows, ["conv"], run, "place long, nth long, role string, text string")


def digests(found: Repair) -> DataFrame:
    """conv and the digest of its repaired turns as ``role:text`` lines.

    One digest reads all lines of a conversation in order, so they stream through one task, which holds none of them.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, digest, between, done = None, None, b"", []
        for conv, place, role, text in _edited(frames):
            if digest is None or conv != name:
                if digest is not None:
                    done.append((name, digest.hexdigest()))
                name, digest, between = conv, hashlib.sha256(), b""
            digest.update(between + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            between = b"\n"
            if len(done) == 1000:
                yield pd.DataFrame(done, columns=["conv", "digest"])
                done = []
        if digest is not None:
            done.append((name, digest.hexdigest()))
        yield pd.DataFrame(done, columns=["conv", "digest"])

    rows = _merged(found)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "conv").sortWithinPartitions("conv", "place", F.col("entry").desc())
    return map_frames(rows, ["conv"], run, "digest string")
