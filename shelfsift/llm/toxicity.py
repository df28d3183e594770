"""Toxicity: cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.common import stored

#: Labelled rows of each label that the fit takes at most, in the order of a hash of their keys.
SAMPLE = 1500
#: Words that become features at most, and their least signed root of the likelihood ratio between toxic and other rows.
FEATURES, LEAST_ROOT = 400, 4.0
#: Lengths of the beginnings of words that are features beside the words; words whose features a task remembers.
BEGINNINGS, REMEMBERED = (3, 4, 5, 6, 7, 8), 50_000
_WORD = re.compile(r"[^\W\d_]+")


def features_of(word: str) -> list[str]:
    """The word and its beginnings, which inflected forms share."""
    return [word, *(f"{word[:k]}*" for k in BEGINNINGS if len(word) > k)]


@dataclass(frozen=True)
class Ordinal:
    """P(grade > k) = sigmoid(weights . x - thresholds[k]); the weights are shared, the thresholds ascend."""

    weights: dict[str, float]
    thresholds: tuple[float, ...]
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, compare=False, repr=False)

    @cached_property
    def heads(self) -> frozenset[str]:
        """The first letters, as many as the shortest beginning has, without which a word has no feature."""
        return frozenset(f.rstrip("*")[:BEGINNINGS[0]] for f in self.weights)

    def score(self, text: str | None) -> float:
        counts: Counter = Counter()
        heads, size = self.heads, BEGINNINGS[0]
        for word in [w for w in _WORD.findall((text or "").lower()) if w[:size] in heads]:
            told = self.known.get(word)
            if told is None:
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                told = self.known[word] = tuple(f for f in features_of(word) if f in self.weights)
            if told:
                counts.update(told)
        return sum(self.weights[w] * math.log1p(n) for w, n in counts.items())

    def above(self, text: str | None) -> list[float]:
        """P(grade > k) for every threshold, falling."""
        at = self.score(text)
        return [1 / (1 + math.exp(min(700.0, t - at))) for t in self.thresholds]


def select_features(counted: DataFrame, clean: int, toxic: int) -> list[str]:
    """Features whose odds of occurring are clearly higher in toxic rows, strongest first; at most FEATURES.

    ``counted`` has a row per labelled row and feature; ``clean`` and ``toxic`` are the numbers of labelled rows.
    """
    seen = counted.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    both = (F.col("t") + F.col("c")) / (toxic + clean)

    def part(seen_: Column, expected: Column) -> Column:
        return F.when(seen_ > 0, seen_ * F.ln(seen_ / expected)).otherwise(0.0)

    ratio = 2 * (part(F.col("t"), toxic * both) + part(F.col("c"), clean * both)
                 + part(toxic - F.col("t"), toxic * (1 - both)) + part(clean - F.col("c"), clean * (1 - both)))
    telling = seen.filter(F.col("t") / toxic > F.col("c") / clean).withColumn("root", F.round(F.sqrt(F.greatest(ratio, F.lit(0.0))), 9))
    best = telling.filter(F.col("root") >= LEAST_ROOT).orderBy(F.desc("root"), "word").limit(FEATURES)
    return [r.word for r in best.select("word").collect()]


def grades(rows: list[Counter], toxic: np.ndarray, features: list[str]) -> np.ndarray:
    """Severity of labelled rows: 0 if not toxic; of the toxic ones 2 where the telling words stand out in
    number (the upper half), else 1. The labels themselves only tell toxic from not toxic."""
    known = set(features)
    marks = np.array([sum(n for w, n in counts.items() if w in known) for counts in rows], float)
    middle = np.median(marks[toxic == 1]) if (toxic == 1).any() else 0
    return np.where(toxic == 1, np.where(marks > middle, 2, 1), 0)


def fit_ordinal(rows: list[Counter], grade: np.ndarray, features: list[str], steps: int = 400, ridge: float = 1e-4) -> Ordinal:
    """Maximum likelihood of the cumulative-link model, with a small ridge, by full gradients with adaptive steps.

    Rows of a label together weigh as the square root of their number: a rare label counts for more than its share, but
    rows of the other one are not given up for it.
    """
    place = {w: i for i, w in enumerate(features)}
    entries = [(i, place[w], math.log1p(n)) for i, counts in enumerate(rows) for w, n in counts.items() if w in place]
    i, j, x = (np.array(c) for c in zip(*entries)) if entries else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    levels, m = 2, len(features)
    beyond = np.stack([grade > k for k in range(levels)], 1).astype(float)
    # Ascending thresholds: the first, and the logarithms of the steps between them.
    theta = np.concatenate([np.zeros(m), [1.0], np.zeros(levels - 1)])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    roots = np.sqrt([max(1, (grade == 0).sum()), max(1, (grade > 0).sum())])
    balance = (1 / roots / roots.sum())[(grade > 0).astype(int)][:, None]
    for step in range(1, steps + 1):
        jumps = np.exp(theta[m + 1:])
        cuts = theta[m] + np.concatenate([[0], np.cumsum(jumps)])
        at = np.bincount(i, x * theta[j], len(rows)) if len(i) else np.zeros(len(rows))
        p = 1 / (1 + np.exp(-np.clip(at[:, None] - cuts, -30, 30)))
        # P(grade = k) is a difference of neighbouring P(grade > k).
        upper = np.concatenate([np.ones((len(rows), 1)), p], 1)
        lower = np.concatenate([p, np.zeros((len(rows), 1))], 1)
        own = np.arange(len(rows)), grade
        likely = np.maximum(upper[own] - lower[own], 1e-9)
        slope = p * (1 - p)
        pull = np.zeros_like(p)
        for k in range(levels):
            pull[:, k] = slope[:, k] * ((grade == k + 1).astype(float) - (grade == k)) / likely
        pull *= balance
        by_row = pull.sum(1)
        by_cut = -pull.sum(0)
        gradient = np.concatenate([
            np.bincount(j, x * by_row[i], m) if len(i) else np.zeros(m),
            [by_cut.sum()], jumps * by_cut[1:]]) - ridge * np.concatenate([theta[:m], np.zeros(levels)])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient ** 2
        theta = theta + 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-9)
    cuts = theta[m] + np.concatenate([[0], np.cumsum(np.exp(theta[m + 1:]))])
    return Ordinal({w: float(theta[k]) for k, w in enumerate(features)}, tuple(map(float, cuts)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id") -> Ordinal:
    """A model from at most ``sample`` labelled keys of either label; without both labels every severity is 0.

    Keys are taken in the order of a hash, null ones and null labels left out; a key with both labels is toxic, and of
    the rows of one key the one with the smallest text counts, so repeated rows don't widen the sample.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    chosen = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64(key), key).limit(sample) for y in (0, 1)]
    rows = docs.select(key, "text").join(F.broadcast(chosen[0].union(chosen[1])), key)  # at most twice ``sample`` keys
    rows = stored(rows.groupBy(key, "toxic").agg(F.min("text").alias("text")), "toxicity-rows")
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")))
    words = rows.select(key, "toxic", word.alias("w")).groupBy(key, "toxic", "w").count()
    begins = [F.when(F.length("w") > k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in BEGINNINGS]
    words = words.select(key, "toxic", "count", F.explode(F.array_compact(F.array("w", *begins))).alias("word"))
    counted = words.groupBy(key, "toxic", "word").agg(F.sum("count").alias("count"))
    counted = stored(counted, "toxicity-counts")
    sizes = [rows.filter(F.col("toxic") == y).count() for y in (0, 1)]
    if not all(sizes):
        return Ordinal({}, (50.0, 60.0))
    features = select_features(counted, *sizes)
    chosen = counted.join(F.broadcast(docs.sparkSession.createDataFrame([(f,) for f in features], "word string")), "word")
    told = chosen.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("word", "count"))).alias("counts"))
    found = rows.select(key, "toxic").join(told, key, "left").orderBy(key).select("counts", "toxic").collect()
    counts, toxic = [Counter(r.counts or {}) for r in found], np.array([r.toxic for r in found])
    return fit_ordinal(counts, grades(counts, toxic, features), features)


def severity(model: Ordinal, text: Column) -> Column:
    """Per text: expected severity (0 to 2), P(grade > 0), and the likeliest grade; null counts as empty."""
    @F.pandas_udf("expected double, toxic_probability double, grade int")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            above = np.array([model.above(t) for t in series]).reshape(len(series), len(model.thresholds))
            shares = -np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1))
            yield pd.DataFrame({"expected": above.sum(1), "toxic_probability": above[:, 0], "grade": shares.argmax(1)})

    return score(text)
