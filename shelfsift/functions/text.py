"""Text analysis as column expressions: tokens, shingles, character trigrams."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII stands first in the classes only because it is tested fastest.
WORD = r"[a-zA-Z0-9\p{L}\p{N}]+"
WORD_WITH_APOSTROPHE = rf"{WORD}(?:['’]{WORD})*"

# Lower-case Latin letters with a diacritic and the ASCII letter under it.
_FOLDED = [
    (chr(code), unicodedata.normalize("NFD", chr(code))[0])
    for code in range(0xDF, 0x180)
    if chr(code).islower() and unicodedata.normalize("NFD", chr(code))[0] in "abcdefghijklmnopqrstuvwxyz"
]
ACCENTED = "".join(a for a, _ in _FOLDED)
PLAIN = "".join(p for _, p in _FOLDED)
# Letters that fold without a decomposition.
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d"}

# The customary English stop words of full-text engines.
ENGLISH_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it",
    "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these",
    "they", "this", "to", "was", "will", "with",
]


# The stop words of the later English stemmer's word list, which relational text search leaves out.
SEARCH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now
""".split()


def fold(text: Column) -> Column:
    """ASCII letters for accented Latin ones; expects lower case. Plain ASCII passes untouched."""
    out = F.translate(text, ACCENTED, PLAIN)
    for ligature, letters in LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(out)


@dataclass(frozen=True)
class Analyzer:
    """How a field becomes terms. Stop words keep their position but yield no term.

    With ``stems`` searches compare the stems of the words; the tables hold the words themselves.
    """

    folded: bool = True
    possessive: bool = False
    stop_words: tuple[str, ...] = ()
    stems: bool = False

    def tokens(self, text: Column) -> Column:
        """All words in order, stop words included, as ``array<string>``."""
        clean = F.lower(F.coalesce(text, F.lit("")))
        if self.folded:
            clean = fold(clean)
        pattern = WORD_WITH_APOSTROPHE if self.possessive else WORD
        words = F.regexp_extract_all(clean, F.lit(pattern), F.lit(0))
        if self.possessive:
            owned = lambda w: w.endswith("'s") | w.endswith("’s")
            words = F.transform(words, lambda w: F.when(owned(w), F.substring(w, F.lit(1), F.length(w) - 2)).otherwise(w))
        return words

    def count(self, text: Column) -> Column:
        """Number of terms; without stop words nothing has to be folded or cut for it."""
        if self.stop_words:
            return F.size(self.terms(text))
        pattern = WORD_WITH_APOSTROPHE if self.possessive else WORD
        return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))

    def keeps(self, term: Column) -> Column:
        """False for stop words."""
        return ~term.isin(*self.stop_words) if self.stop_words else F.lit(True)

    def terms(self, text: Column) -> Column:
        """Words without the stop words."""
        words = self.tokens(text)
        return F.filter(words, self.keeps) if self.stop_words else words


PRODUCT = Analyzer()
PLAIN_WORDS = Analyzer(folded=False)
ENGLISH_TEXT = Analyzer(folded=False, stop_words=tuple(SEARCH_STOP_WORDS), stems=True)
ENGLISH_REVIEW = Analyzer(possessive=True, stop_words=tuple(ENGLISH_STOP_WORDS))


def shingles(tokens: Column, n: int) -> Column:
    """Runs of ``n`` neighbouring tokens joined by a blank; empty when there are fewer."""
    runs = F.transform(
        F.sequence(F.lit(1), F.size(tokens) - (n - 1)),
        lambda i: F.array_join(F.slice(tokens, i, n), " "),
    )
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))


def word_trigrams(text: Column) -> Column:
    """Distinct 3-character pieces of every word, padded by two blanks before and one after."""
    padded = F.transform(
        PLAIN_WORDS.tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" "))
    )
    pieces = F.transform(
        padded,
        lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))),
    )
    return F.array_distinct(F.flatten(pieces))
