"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")
SHORTEST_VALUE = 12

#: Strings that the models judge, as long as the base's shortest value, and what they are trained on.
CANDIDATE = r"[A-Za-z0-9+/_=-]{12,}"
IDENTIFIER = r"[A-Za-z0-9+/_=-]{8,}"
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Documents whose strings train the models at most, in the order of a hash of their keys.
SAMPLE = 20_000
#: Least log-likelihood ratio of a secret, in all and per pair of characters.
LEAST_RATIO, LEAST_MEAN = 6.0, 0.3


#: Matches whose places are added up in one go; a long text has rounds of as many.
ROUND = 256


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, as the one element of an array, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (gap, whole, part): each match after the text before it; the text after the last one is a gap without a match."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def zipped(whole: Column) -> Column:
        part = F.transform(whole, lambda w: F.regexp_extract(w, pattern, group)) if group else whole
        # Without a match the text needn't be searched again for the gaps.
        gaps = F.when(F.size(whole) > 0, F.split(text, pattern, -1)).otherwise(F.array(text))
        return F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), part.alias("part"))

    return _bound(whole, zipped)


def _placed(matches: Column) -> Column:
    """The matches as array of (start, end, string), in code points; the string is the match's part.

    Matches and gaps alternate, so their lengths add up to the places. They are added up in rounds, so that the work of
    appending doesn't grow with the square of their number.
    """
    kind = "array<struct<start:bigint,end:bigint,string:string>>"
    none = F.array().cast(kind)

    def one(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.coalesce(F.length(x["whole"]), F.lit(0))
        own = F.array(F.struct(begin.alias("start"), end.alias("end"), x["part"].alias("string")))
        return F.struct(end.alias("at"), F.when(x["whole"].isNull(), state["found"]).otherwise(F.concat(state["found"], own)).alias("found"))

    def some(state: Column, number: Column) -> Column:
        begin = F.struct(state["at"].alias("at"), none.alias("found"))
        done = F.aggregate(F.slice(matches, number * ROUND + 1, ROUND), begin, one)
        return F.struct(done["at"].alias("at"), F.concat(state["found"], F.array(done["found"])).alias("found"))

    rounds = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / ROUND).cast("int"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("found"))
    return F.when(F.size(matches) > 1, F.flatten(F.aggregate(rounds, start, some)["found"])).otherwise(none)


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost matches that don't overlap as array of (start, end, string), in code points; the string is the group."""
    return _bound(_matches(text, pattern, group), _placed)


def _blanked(matches: Column, least: int = 1) -> Column:
    """The text of the matches with as many blanks in place of every one whose part is at least so long."""
    def one(x: Column) -> Column:
        blank = F.when(F.length(x["part"]) >= least, F.repeat(F.lit(" "), F.length(x["whole"]))).otherwise(x["whole"])
        return F.concat(x["gap"], F.coalesce(blank, F.lit("")))

    return F.array_join(F.transform(matches, one), "")


def _codes(string: Column) -> Column:
    """Numbers of the characters among the symbols, 1 the first."""
    return F.transform(F.split(string, ""), lambda c: F.instr(F.lit(SYMBOLS), c))


def _pairs(string: Column) -> Column:
    """A number for each pair of neighbouring characters, 0 the first."""
    n = len(SYMBOLS)
    following = F.slice(_codes(string), 2, F.length(string))
    pairs = F.zip_with(_codes(string), following, lambda a, b: (a - 1) * n + b - 1)
    return F.filter(pairs, lambda p: p.isNotNull())  # the last character has no following one


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratio of each pair of characters: random strings against ordinary identifiers.

    Labelled by the base: its values are the random strings, the other long words of the same documents are the ordinary ones.
    Taken from at most ``sample`` documents. Counts are smoothed towards equal shares, so that without any labelled
    string every ratio is 0.
    """
    chosen = docs.select(F.col(key).alias("id")).filter("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen.distinct()), "id")
    random = F.concat(
        F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(1)), F.regexp_extract_all("t", F.lit(ACCESS), F.lit(0)),
        F.regexp_extract_all("t", F.lit(HEX), F.lit(0)))
    random = F.transform(F.filter(random, lambda x: F.length(x) >= SHORTEST_VALUE), lambda x: F.regexp_replace(x, r"\.", "-"))
    rest = F.regexp_replace("t", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    ordinary = F.regexp_extract_all(rest, F.lit(IDENTIFIER), F.lit(0))
    label = F.transform(random, lambda x: F.struct(F.lit(True).alias("random"), x.alias("s")))
    label = F.concat(label, F.transform(ordinary, lambda x: F.struct(F.lit(False).alias("random"), x.alias("s"))))
    strings = rows.filter("t IS NOT NULL").select(F.explode(label).alias("x")).select("x.*")
    strings = strings.groupBy("random", "s").agg(F.count(F.lit(1)).alias("times"))  # words recur; their pairs are made once
    counted = strings.select("random", "times", F.explode(_pairs(F.col("s"))).alias("pair"))
    n = len(SYMBOLS)
    seen = {True: [0] * n * n, False: [0] * n * n}
    for random_, pair, times in counted.groupBy("random", "pair").agg(F.sum("times")).collect():  # at most 2 n * n rows
        seen[random_][pair] = times
    ratio = []
    for first in range(n):
        row = {label: seen[label][first * n:first * n + n] for label in seen}
        logs = {label: [math.log((c + 0.5) / (sum(counts) + 0.5 * n)) for c in counts] for label, counts in row.items()}
        ratio += [a - b for a, b in zip(logs[True], logs[False])]
    return ratio if any(seen[True]) and any(seen[False]) else [0.0] * (n * n)


def log_ratio(string: Column, ratio: list[float]) -> Column:
    """Sum of the ratios of neighbouring characters, in one pass: the state is the last character's number and the sum."""
    n = len(SYMBOLS)
    by_number = [0.0] * (128 * 128)  # what follows no character adds nothing
    for i, a in enumerate(SYMBOLS):
        for j, b in enumerate(SYMBOLS):
            by_number[ord(a) * 128 + ord(b)] = ratio[i * n + j]
    table = F.lit(by_number)

    def add(state: Column, c: Column) -> Column:
        number = F.ascii(c)
        return F.struct(number.alias("last"), (state["total"] + F.get(table, state["last"] * 128 + number)).alias("total"))

    begin = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("total"))
    return F.aggregate(F.split(string, ""), begin, add, lambda state: state["total"])


def looks_random(string: Column, ratio: list[float]) -> Column:
    """Whether a string is likelier under the random model than under the ordinary one by both margins."""
    value = log_ratio(string, ratio)
    return (value >= LEAST_RATIO) & (value >= LEAST_MEAN * (F.length(string) - 1))


def scan(docs: DataFrame, ratio: list[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: ``key``, n_assign, n_access, n_hex, base, spans; the last two as kind:start:end lists.

    Base matches are those of the fixed patterns, long enough ones. A Markov span is a run of at least 12 characters outside
    all base spans that is likelier under the random model than under the ordinary one by the stated margins. Null and
    empty texts have no spans; each row stands alone, so repeated rows and equal keys have equal results, a long text is
    scanned whole, other columns play no part, and an empty table gives an empty result.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    def assigned(m: Column) -> Column:
        own = F.filter(_placed(m), lambda s: F.length(s["string"]) >= SHORTEST_VALUE)
        return F.struct(own.alias("spans"), _blanked(m, SHORTEST_VALUE).alias("rest"))

    def judged(rest: Column) -> Column:
        return F.filter(spans(rest, CANDIDATE), lambda s: looks_random(s["string"], ratio))

    rows = rows.withColumns({
        "__first": _bound(_matches(F.col("__t"), ASSIGN, 1), assigned), "__1": spans(F.col("__t"), ACCESS), "__2": spans(F.col("__t"), HEX)})
    others = _bound(F.col("__first.rest"), lambda t: _bound(_matches(t, f"{ACCESS}|{HEX}"), _blanked))
    rows = rows.withColumns({"__0": F.col("__first.spans"), "__3": _bound(others, judged)})

    def of_kind(k: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"))

    def listed(kinds: range) -> Column:
        marked = F.concat(*(F.transform(f"__{k}", of_kind(k)) for k in kinds))
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(F.array_sort(marked), lambda s: F.concat_ws(
            ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    return rows.select(
        key, *(F.size(f"__{k}").cast("long").alias(f"n_{KINDS[k]}") for k in range(3)),
        listed(range(3)).alias("base"), listed(range(4)).alias("spans"))
