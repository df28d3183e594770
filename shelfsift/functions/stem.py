"""English stemming by the published suffix-stripping algorithms: Porter's of 1980 and his later English (Porter2) one.

Meant for the distinct terms of a vocabulary, never for corpus rows.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffix tables of the paper, steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]


_LETTERS = str.maketrans({ch: "v" if ch in "aeiou" else "c" for ch in "abcdefghijklmnopqrstuvwxyz"})


def _shape(word: str) -> str:
    """c for consonants and v for vowels; y is a vowel after a consonant."""
    if "y" not in word and word.isalpha() and word.isascii() and word.islower():
        return word.translate(_LETTERS)
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    # A run of vowels with consonants behind it ends where a vowel meets a consonant.
    return _shape(stem).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short_end(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


@lru_cache
def _by_length(suffixes: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(sorted(suffixes, key=len, reverse=True))


def _longest(word: str, suffixes) -> str | None:
    """The longest of the suffixes that the word has."""
    every = tuple(suffixes)
    if not word.endswith(every):
        return None
    return next(s for s in _by_length(every) if word.endswith(s))


def _swap_longest(word: str, table: dict[str, str]) -> str:
    suffix = _longest(word, table)
    if suffix is None:
        return word
    stem = word[: -len(suffix)]
    return stem + table[suffix] if _measure(stem) > 0 else word


def stem_word(word: str) -> str:
    if len(word) <= 2 or not word.isascii() or not word.isalpha():
        return word
    for suffix, cut in (("sses", 2), ("ies", 2), ("ss", 0), ("s", 1)):
        if word.endswith(suffix):
            word = word[: len(word) - cut]
            break
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _doubled(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _swap_longest(word, STEP_2)
    word = _swap_longest(word, STEP_3)
    suffix = _longest(word, STEP_4)
    if suffix:
        stem = word[: -len(suffix)]
        if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


@F.pandas_udf(T.StringType())
def stem(terms: pd.Series) -> pd.Series:
    return terms.map(stem_word)


# The later algorithm ----------------------------------------------------------

# Word tables of the algorithm's description.
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEPT_AFTER_PLURALS = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
LONG_BEGINNINGS = ["gener", "commun", "arsen"]
LATER_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
LATER_STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
    "ative": "",
}
LATER_STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive",
    "ize", "ion",
]
DOUBLES = ["bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"]
LI_ENDINGS = "cdeghkmnrt"

_VOWELS = "aeiouy"
_REGION = re.compile("[aeiouy][^aeiouy]")
_SHORT = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")


def _regions(word: str) -> tuple[int, int]:
    """Where the regions behind the first and the second consonant that follows a vowel begin."""
    first = next((len(b) for b in LONG_BEGINNINGS if word.startswith(b)), None)
    if first is None:
        found = _REGION.search(word)
        first = found.end() if found else len(word)
    found = _REGION.search(word, first)
    return first, found.end() if found else len(word)


def _without_plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and any(c in _VOWELS for c in word[:-2]):
        return word[:-1]
    return word


def _without_participle(word: str, first: int) -> str:
    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if not word.endswith(suffix):
            continue
        stem = word[:-len(suffix)]
        if suffix.startswith("eed"):
            return stem + "ee" if len(stem) >= first else word
        if not any(c in _VOWELS for c in stem):
            return word
        if stem.endswith(("at", "bl", "iz")):
            return stem + "e"
        if stem[-2:] in DOUBLES:
            return stem[:-1]
        return stem + "e" if len(stem) <= first and _SHORT.search(stem) else stem
    return word


def later_stem(word: str) -> str:
    """Stem of a lower-case word by the later algorithm."""
    if len(word) <= 2:
        return word
    if word in WHOLE_WORDS:
        return WHOLE_WORDS[word]
    word = re.sub("(^|[aeiouy])y", r"\1Y", word.lstrip("'"))
    first, second = _regions(word)
    word = _without_plural(re.sub("('s'|'s|')$", "", word))
    if word in KEPT_AFTER_PLURALS:
        return word
    word = _without_participle(word, first)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    suffix = _longest(word, LATER_STEP_2)
    if suffix and len(word) - len(suffix) >= first:
        stem = word[:-len(suffix)]
        if {"ogi": stem.endswith("l"), "li": stem[-1:] in tuple(LI_ENDINGS)}.get(suffix, True):
            word = stem + LATER_STEP_2[suffix]
    suffix = _longest(word, LATER_STEP_3)
    if suffix and len(word) - len(suffix) >= (second if suffix == "ative" else first):
        word = word[:-len(suffix)] + LATER_STEP_3[suffix]
    suffix = _longest(word, LATER_STEP_4)
    if suffix and len(word) - len(suffix) >= second and (suffix != "ion" or word[-4:-3] in ("s", "t")):
        word = word[:-len(suffix)]
    if word.endswith("e"):
        at = len(word) - 1
        if at >= second or (at >= first and not _SHORT.search(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= second:
        word = word[:-1]
    return word.lower()


@F.pandas_udf(T.StringType())
def english_stem(terms: pd.Series) -> pd.Series:
    return terms.map(later_stem)
