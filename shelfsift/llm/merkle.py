"""Document fingerprints: a Merkle tree over sections, paragraphs and their sentences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.common import map_frames

#: A longer sentence is cut every so many characters, so that an edit in it stays local.
LEAF = 120
#: Bytes of a hash, leaves included: a root is no surer than what lies under it.
DIGEST = 16
_PARAGRAPH = re.compile(r"[^\n]*\n+|[^\n]+")
_SENTENCE = re.compile(r"(?<=[.!?]\s)")

#: A node: its hash, its length in code points, its children (leaves have none).
Node = tuple[str, int, tuple]


def _hash(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=DIGEST).hexdigest()


def _over(children: list[Node]) -> Node:
    return _hash("".join(c[0] for c in children)), sum(c[1] for c in children), tuple(children)


def tree(text: str | None) -> Node:
    """The tree of a whole text; null is an empty text.

    Paragraphs end with a line, sections after a blank line or after a paragraph chosen by its own
    hash, one in four, so that an inserted paragraph moves no other section's borders.
    """
    sections: list[Node] = []
    paragraphs: list[Node] = []
    for paragraph in _PARAGRAPH.findall(text or ""):
        leaves = []
        for sentence in _SENTENCE.split(paragraph):
            for at in range(0, len(sentence), LEAF):
                piece = sentence[at:at + LEAF]
                leaves.append((_hash(piece), len(piece), ()))
        node = _over(leaves)
        paragraphs.append(node)
        if paragraph.endswith("\n\n") or node[0][0] in "0123":
            sections.append(_over(paragraphs))
            paragraphs = []
    if paragraphs:
        sections.append(_over(paragraphs))
    return _over(sections)


def to_text(node: Node) -> str:
    """hash.length, and the children in brackets."""
    inside = f"({','.join(map(to_text, node[2]))})" if node[2] else ""
    return f"{node[0]}.{node[1]:x}{inside}"


def from_text(fingerprint: str) -> Node:
    stack: list[list[Node]] = [[]]
    for token in re.findall(r"[^(),]+|[()]", fingerprint):
        if token == "(":
            stack.append([])
        elif token == ")":
            children = tuple(stack.pop())
            stack[-1][-1] = (*stack[-1][-1][:2], children)
        else:
            digest, _, size = token.partition(".")
            stack[-1].append((digest, int(size, 16), ()))
    return stack[0][0]


def _unmatched(nodes: list[Node], others: Counter) -> list[Node]:
    left, rest = Counter(others), []
    for node in nodes:
        if left[node[0]] > 0:
            left[node[0]] -= 1
        else:
            rest.append(node)
    return rest


def likeness(a: Node, b: Node) -> float:
    """Share of the two texts' characters under equal nodes, from 0 to 1; equal roots give 1.

    Equal sections count whole; only differing ones are opened, then only their differing paragraphs.
    """
    if a[0] == b[0]:
        return 1.0
    total, ours, theirs = a[1] + b[1], [a], [b]
    for _ in range(3):
        ours = [child for node in ours for child in node[2]]
        theirs = [child for node in theirs for child in node[2]]
        one, two = Counter(n[0] for n in ours), Counter(n[0] for n in theirs)
        ours, theirs = _unmatched(ours, two), _unmatched(theirs, one)
    return 1.0 - sum(n[1] for n in ours + theirs) / total if total else 0.0


def edits(a: Node, b: Node) -> list[tuple[int, int]]:
    """Code-point ranges of the first text whose leaves the second lacks: differing branches locate the edits."""
    found: list[tuple[int, int]] = []

    def walk(node: Node, other: list[Node], at: int) -> None:
        below = [child for n in other for child in n[2]]
        hashes = {n[0] for n in below}
        for child in node[2]:
            if child[0] not in hashes:
                if child[2]:
                    walk(child, below, at)
                elif found and found[-1][1] == at:
                    found[-1] = (found[-1][0], at + child[1])
                else:
                    found.append((at, at + child[1]))
            at += child[1]

    if a[0] != b[0]:
        walk(a, [b], 0)
    return found


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the following text."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def with_following(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows dealt out by ranges of the key and sorted in them, each range followed by the next one's first row.

    Texts are shuffled once. Columns: __range, __tail (a row borrowed from the next range), ``key`` and __text. After
    the last range comes the first row of all. Null keys are last; of equal keys the smaller text is first.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*(F.lit(i / parts) for i in range(1, max(2, parts))))
    cuts = sorted(set(docs.select(F.percentile_approx(key, shares, 10000)).first()[0] or []))
    borders = F.lit(cuts) if cuts else F.array().cast("array<long>")
    place = F.when(F.col(key).isNull(), len(cuts)).otherwise(F.size(F.filter(borders, lambda c: c < F.col(key))))
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text"), place.alias("__range"))
    firsts = sorted(rows.groupBy("__range").agg(F.min(key)).collect())  # a row per range
    before = {at: firsts[i - 1][0] for i, (at, _) in enumerate(firsts)}
    own = F.struct(F.col("__range"), F.lit(False).alias("__tail"))
    low = F.broadcast(spark.createDataFrame(
        [(at, before[at], low) for at, low in firsts], f"__range int, __lent int, __low {dict(rows.dtypes)[key]}"))
    lent = F.struct(F.col("__lent").alias("__range"), F.lit(True).alias("__tail"))
    first = F.col(key).eqNullSafe(F.col("__low"))
    to = F.when(first, F.array(own, lent)).otherwise(F.array(own))
    rows = rows.join(low, "__range")
    rows = rows.select(key, "__text", F.explode(to).alias("to")).select("to.*", key, "__text")
    order = ["__range", "__tail", F.col(key).asc_nulls_last(), "__text"]
    return rows.repartition(parts, "__range").sortWithinPartitions(*order)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text takes its end from the next document by ``key``, after the last one from the first. Null texts are
    empty; equal texts have equal fingerprints; a lone document is its own next one. An empty table gives an empty result.
    """
    rows = with_following(docs, key, text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None  # the last row whose next one hasn't come
        for frame in frames:
            out = []
            columns = (frame[c] for c in ("__range", "__tail", key, "__text"))
            for place, tail, name, own in zip(*columns):
                node = tree(own)
                if waiting and waiting[0] == place:
                    out.append(compared(*waiting[1:], own, node))
                waiting = None if tail else (place, name, own, node)
            names = (key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
            if out:
                yield pd.DataFrame(out, columns=names)

    def compared(name, own: str, node: Node, following: str, next_node: Node) -> tuple:
        changed = edited(own, following)
        other = tree(changed)
        digest = sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return (name, len(own), digest, to_text(node), to_text(other), likeness(node, other), likeness(node, next_node))

    return map_frames(
        rows, [key], run,
        "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")
