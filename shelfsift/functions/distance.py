"""Edit distance with transpositions, and the deletion keys that make it an equi-join."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_EDITS = 2
_TOO_FAR = MAX_EDITS + 1
#: Letters at the beginning of a term that its deletion keys are made from.
KEY_LETTERS = 7


def auto_edits(term: Column) -> Column:
    """Allowed edits by length: up to 2 characters none, 3 to 5 one, from 6 on two."""
    return F.when(F.length(term) <= 2, 0).when(F.length(term) <= 5, 1).otherwise(2)


def ladder_edits(term: Column) -> Column:
    """Allowed typos of the ladder dialect: below 5 characters none, below 9 one, else two."""
    return F.when(F.length(term) < 5, 0).when(F.length(term) < 9, 1).otherwise(2)


def _swaps(term: Column) -> Column:
    """The term with each pair of neighbours exchanged."""
    swapped = F.transform(
        F.sequence(F.lit(1), F.length(term) - 1),
        lambda i: F.concat(
            F.substring(term, F.lit(1), i - 1), F.substring(term, i + 1, F.lit(1)),
            F.substring(term, i, F.lit(1)), F.substring(term, i + 2, F.length(term)),
        ),
    )
    return F.when(F.length(term) >= 2, swapped).otherwise(F.array().cast("array<string>"))


def _bounded(a: Column, b: Column, limit: int) -> Column:
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, F.lit(_TOO_FAR)).otherwise(d)


def edit_distance(a: Column, b: Column) -> Column:
    """Damerau-Levenshtein distance up to 2; 3 stands for "farther".

    A transposition combines with at most one other edit, so it is enough to
    try one swap on either side with one plain edit left, and two swaps.
    """
    plain = _bounded(a, b, MAX_EDITS)
    one_swap = lambda x, y: F.coalesce(
        F.array_min(F.transform(_swaps(x), lambda s: _bounded(s, y, 1))) + 1, F.lit(_TOO_FAR)
    )
    two_swaps = F.when(
        F.array_contains(F.flatten(F.transform(_swaps(a), _swaps)), b), F.lit(2)
    ).otherwise(F.lit(_TOO_FAR))
    swapped = F.least(one_swap(a, b), one_swap(b, a), two_swaps, F.lit(_TOO_FAR))
    return F.when(plain <= 1, plain).otherwise(F.least(plain, swapped))


def _without(term: Column, places: tuple[int, ...]) -> Column:
    """The term without the letters at these places, counted from 1 and ascending; places behind its end change nothing."""
    borders = [0, *places, KEY_LETTERS + 1]
    return F.concat(*[F.substring(term, a + 1, b - a - 1) for a, b in zip(borders, borders[1:]) if b - a > 1])


def deletion_keys(term: Column, edits: Column) -> Column:
    """The first ``KEY_LETTERS`` letters with up to ``edits`` of them left out, distinct.

    Two terms within ``k`` edits always share a form with at most ``k``
    characters deleted on each side. So do their beginnings: where more was
    deleted in the one, the other leaves out as many of its last letters, and
    neither leaves out more than ``k``. Equality on these keys therefore finds
    every pair that the distance test can accept, and their number doesn't
    grow with the length of a term.
    """
    start, letters = F.substring(term, 1, KEY_LETTERS), range(1, KEY_LETTERS + 1)
    none = F.array().cast("array<string>")
    once = F.when(edits >= 1, F.array(*[_without(start, (i,)) for i in letters])).otherwise(none)
    twice = F.when(edits >= 2, F.array(*[_without(start, pair) for pair in combinations(letters, 2)])).otherwise(none)
    return F.array_distinct(F.concat(F.array(start), once, twice))
