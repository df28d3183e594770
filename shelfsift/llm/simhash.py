"""SimHash near-duplicates: tiled exact comparison, tiles skipped by population counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.common import components, map_frames, stored

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints compared at once; bounds the memory of a tile pair.
TILE = 2048
_BASE = 17  # a quarter of 16 bits has a population count of 0 to 16


def fingerprint(text: str | None) -> int:
    """The signed 64-bit SimHash of a whole text; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) > SHINGLE:
        grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    elif words:
        grams = [b" ".join(words)]
    else:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    counts = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``fp`` of every document."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prints = np.fromiter(map(fingerprint, frame.pop("__text")), np.int64, len(frame))
            yield frame.assign(fp=prints)

    rows = docs.select(*keys, F.col(text).alias("__text"))
    return map_frames(rows, keys, run, "fp long")


def _forest(edges: np.ndarray, nodes: int) -> np.ndarray:
    """Those of the edges that are enough to connect what all of them connect."""
    parent = list(range(nodes))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    kept = []
    for k, (i, j) in enumerate(edges.tolist()):
        i, j = root(i), root(j)
        if i != j:
            parent[i] = j
            kept.append(k)
    return edges[kept]


def compare_tiles(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Links (value of a, value of b) of at most ``radius`` differing bits, thinned to a forest."""
    found = []
    for start in range(0, len(a), 256):
        differing = a[start:start + 256, None] ^ b[None, :]
        near = np.bitwise_count(differing.view(np.uint64)) <= radius  # of a signed number it counts the absolute value's
        i, j = np.nonzero(near)
        found.append(np.stack([i + start, j + len(a)], 1))
    edges = np.concatenate(found)
    both = np.concatenate([a, b])
    edges = edges[both[edges[:, 0]] != both[edges[:, 1]]]
    return both[_forest(edges, len(both))] if len(edges) > len(both) else both[edges]


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that differ in at most ``radius`` bits, or as many as
    connect the same.

    A tile holds fingerprints of equal population counts in each quarter. The counts of two quarters differ by
    no more than the quarters' bits do, so tile pairs whose counts differ by more than the radius in sum are skipped.
    Large tiles are cut into blocks by hash, and each pair of blocks is a row of the join.
    """
    quarters = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    keyed = classes.select("fp", *(q.alias(f"q{i}") for i, q in enumerate(quarters)))
    names = [f"q{i}" for i in range(4)]
    blocks = keyed.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / TILE).alias("blocks"))
    keyed = keyed.join(F.broadcast(blocks), names)  # at most 17 ** 4 rows
    tiles = stored(
        keyed.groupBy(*names, F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("block"))
        .agg(F.collect_list("fp").alias("fps")), "simhash-tiles",
    )

    def code(moved: tuple[int, ...] = (0, 0, 0, 0)):
        total = F.lit(0)
        for name, by in zip(names, moved):
            total = total * (_BASE + 2 * radius) + F.col(name) + by + radius
        return total

    moves = [m for m in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, m)) <= radius and m >= (0, 0, 0, 0)]
    left = tiles.select("fps", "block", F.explode(F.array(*(
        F.struct(code(m).alias("code"), F.lit(m == (0, 0, 0, 0)).alias("own")) for m in moves))).alias("to"))
    left = left.select(F.col("fps").alias("a"), F.col("block").alias("__block"), "to.code", "to.own")
    right = tiles.select(F.col("fps").alias("b"), "block", code().alias("code"))
    pairs = left.join(right, "code").filter(~F.col("own") | (F.col("__block") <= F.col("block"))).select("a", "b")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b in zip(frame["a"], frame["b"]):
                near = compare_tiles(np.asarray(a, np.int64), np.asarray(b, np.int64), radius)
                if len(near):
                    yield pd.DataFrame({"a": near[:, 0], "b": near[:, 1]})

    return pairs.mapInPandas(run, "a long, b long")


def near_dedup(docs: DataFrame, keys: list[str], radius: int = RADIUS) -> DataFrame:
    """Every document's ``keys`` with ``fp``, ``root``, the smallest fingerprint of its component, and ``component``, its smallest first key.

    Null and wordless texts have fingerprint zero and are linked like any other. Rows of equal fingerprint are
    compared once, as a class. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, keys), "simhash-prints")
    classes = stored(prints.groupBy("fp").agg(F.min(keys[0]).alias("low")), "simhash-classes")
    roots = components(links(classes, radius)).withColumnRenamed("node", "fp")
    classes = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = classes.groupBy("root").agg(F.min("low").alias("component"))
    return prints.join(classes.join(names, "root").select("fp", "root", "component"), "fp")


def hexadecimal(fp):
    """16 lower-case digits, as for an unsigned number."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
