"""Both stemmers as chains of CTEs, for the SQL twins: every step is one CASE over regular expressions.

A consonantal y is written Y while the steps run, so that vowels and consonants are plain character classes.
"""

from __future__ import annotations

from shelfsift.functions import stem as S

_V, _C = "[aeiouy]", "[^aeiouy]"
_SHORT = f"({_C}{_V}[^aeiouywxY]|^{_V}{_C})$"


def _cut(n: int) -> str:
    return f"left(w, length(w) - {n})"


def _cases(branches: list[str], otherwise: str = "w") -> str:
    return f"CASE {' '.join(branches)} ELSE {otherwise} END"


def _swaps(table: dict[str, str], condition) -> str:
    """The longest suffix of the table decides alone; ``condition`` of its stem, its length and itself must hold."""
    branches = []
    for suffix in sorted(table, key=len, reverse=True):
        kept = _cut(len(suffix))
        branches.append(
            f"WHEN w LIKE '%{suffix}' THEN CASE WHEN {condition(kept, len(suffix), suffix)} THEN {kept} || '{table[suffix]}' ELSE w END")
    return _cases(branches)


def later_stems_sql(source: str, name: str) -> str:
    """CTE ``name`` (term, stem) of the distinct terms in ``source``, by the later algorithm; terms without apostrophes."""
    n = name
    begins = " ".join(f"WHEN w LIKE '{b}%' THEN {len(b)}" for b in S.LONG_BEGINNINGS)
    region = f"^.*?{_V}{_C}"
    in_first = lambda kept, size, _: f"length(w) - {size} >= first"
    whole = " ".join(f"WHEN '{word}' THEN '{found}'" for word, found in S.WHOLE_WORDS.items())
    kept_words = ", ".join(f"'{w}'" for w in S.KEPT_AFTER_PLURALS)
    doubles = ", ".join(f"'{d}'" for d in S.DOUBLES)

    def second_step(kept: str, size: int, suffix: str) -> str:
        more = {"ogi": f" AND {kept} LIKE '%l'", "li": f" AND regexp_matches({kept}, '[{S.LI_ENDINGS}]$')"}.get(suffix, "")
        return f"length(w) - {size} >= first{more}"

    def third_step(_: str, size: int, suffix: str) -> str:
        return f"length(w) - {size} >= {'second' if suffix == 'ative' else 'first'}"

    def fourth_step(kept: str, size: int, suffix: str) -> str:
        more = f" AND regexp_matches({kept}, '[st]$')" if suffix == "ion" else ""
        return f"length(w) - {size} >= second{more}"

    parts = []
    for suffix in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        kept = _cut(len(suffix))
        if suffix.startswith("eed"):
            parts.append(f"WHEN w LIKE '%{suffix}' THEN CASE WHEN length(w) - {len(suffix)} >= first THEN {kept} || 'ee' ELSE w END")
            continue
        parts.append(
            f"WHEN w LIKE '%{suffix}' THEN CASE WHEN NOT regexp_matches({kept}, '{_V}') THEN w "
            f"WHEN regexp_matches({kept}, '(at|bl|iz)$') THEN {kept} || 'e' "
            f"WHEN right({kept}, 2) IN ({doubles}) THEN {_cut(len(suffix) + 1)} "
            f"WHEN length(w) - {len(suffix)} <= first AND regexp_matches({kept}, '{_SHORT}') THEN {kept} || 'e' ELSE {kept} END")
    return f"""{n}_0 AS (SELECT term, regexp_replace(term, '(^|{_V})y', '\\1Y', 'g') AS w FROM (SELECT DISTINCT term FROM {source})),
    {n}_1 AS (SELECT *, CASE {begins} ELSE coalesce(nullif(length(regexp_extract(w, '{region}')), 0), length(w)) END AS first FROM {n}_0),
    {n}_2 AS (SELECT *, coalesce(first + nullif(length(regexp_extract(substring(w, first + 1), '{region}')), 0), length(w)) AS second FROM {n}_1),
    {n}_3 AS (SELECT term, first, second, CASE WHEN w LIKE '%sses' THEN {_cut(2)} WHEN w LIKE '%ied' OR w LIKE '%ies'
                THEN CASE WHEN length(w) > 4 THEN {_cut(2)} ELSE {_cut(1)} END
              WHEN w LIKE '%s' AND w NOT LIKE '%us' AND w NOT LIKE '%ss' AND regexp_matches({_cut(2)}, '{_V}') THEN {_cut(1)} ELSE w END AS w FROM {n}_2),
    {n}_4 AS (SELECT term, first, second, CASE WHEN w IN ({kept_words}) THEN w END AS done, {_cases(parts)} AS w FROM {n}_3),
    {n}_5 AS (SELECT term, first, second, done, CASE WHEN length(w) > 2 AND regexp_matches(w, '{_C}[yY]$') THEN {_cut(1)} || 'i' ELSE w END AS w FROM {n}_4),
    {n}_6 AS (SELECT term, first, second, done, {_swaps(S.LATER_STEP_2, second_step)} AS w FROM {n}_5),
    {n}_7 AS (SELECT term, first, second, done, {_swaps(S.LATER_STEP_3, third_step)} AS w FROM {n}_6),
    {n}_8 AS (SELECT term, first, second, done, {_swaps(dict.fromkeys(S.LATER_STEP_4, ''), fourth_step)} AS w FROM {n}_7),
    {n}_9 AS (SELECT term, done, CASE WHEN w LIKE '%e' THEN CASE WHEN length(w) - 1 >= second OR (length(w) - 1 >= first
                AND NOT regexp_matches({_cut(1)}, '{_SHORT}')) THEN {_cut(1)} ELSE w END
              WHEN w LIKE '%ll' AND length(w) - 1 >= second THEN {_cut(1)} ELSE w END AS w FROM {n}_8),
    {n} AS (SELECT term, CASE WHEN length(term) <= 2 THEN term
              ELSE coalesce(CASE term {whole} END, done, lower(w)) END AS stem FROM {n}_9)"""


def stems_sql(source: str, name: str) -> str:
    """CTE ``name`` (term, stem) of the distinct terms in ``source``, by the algorithm of 1980."""
    n = name
    once, twice = f"^{_C}*{_V}+{_C}", f"^{_C}*({_V}+{_C}+){{2}}"
    single = f"^{_C}*{_V}+{_C}+{_V}*$"
    short = f"{_C}{_V}[^aeiouywxY]$"
    over = lambda kept, _, __: f"regexp_matches({kept}, '{once}')"

    def fourth_step(kept: str, _: int, suffix: str) -> str:
        more = f" AND regexp_matches({kept}, '[st]$')" if suffix == "ion" else ""
        return f"regexp_matches({kept}, '{twice}'){more}"

    parts = [f"WHEN w LIKE '%eed' THEN CASE WHEN regexp_matches({_cut(3)}, '{once}') THEN {_cut(1)} ELSE w END"]
    for suffix in ("ed", "ing"):
        kept = _cut(len(suffix))
        parts.append(
            f"WHEN w LIKE '%{suffix}' AND regexp_matches({kept}, '{_V}') THEN CASE WHEN regexp_matches({kept}, '(at|bl|iz)$') THEN {kept} || 'e' "
            f"WHEN lower(right({kept}, 1)) = lower(left(right({kept}, 2), 1)) AND length({kept}) > 1 AND regexp_matches({kept}, '[^aeiouylsz]$') THEN {_cut(len(suffix) + 1)} "
            f"WHEN regexp_matches({kept}, '{single}') AND regexp_matches({kept}, '{short}') THEN {kept} || 'e' ELSE {kept} END")
    return f"""{n}_0 AS (SELECT term, regexp_replace(regexp_replace(term, '(^|[aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g') AS w
              FROM (SELECT DISTINCT term FROM {source})),
    {n}_1 AS (SELECT term, CASE WHEN w LIKE '%sses' THEN {_cut(2)} WHEN w LIKE '%ies' THEN {_cut(2)} WHEN w LIKE '%ss' THEN w
              WHEN w LIKE '%s' THEN {_cut(1)} ELSE w END AS w FROM {n}_0),
    {n}_2 AS (SELECT term, {_cases(parts)} AS w FROM {n}_1),
    {n}_3 AS (SELECT term, CASE WHEN regexp_matches(w, '{_V}.*[yY]$') THEN {_cut(1)} || 'i' ELSE w END AS w FROM {n}_2),
    {n}_4 AS (SELECT term, {_swaps(S.STEP_2, over)} AS w FROM {n}_3),
    {n}_5 AS (SELECT term, {_swaps(S.STEP_3, over)} AS w FROM {n}_4),
    {n}_6 AS (SELECT term, {_swaps(dict.fromkeys(S.STEP_4, ''), fourth_step)} AS w FROM {n}_5),
    {n}_7 AS (SELECT term, CASE WHEN w LIKE '%e' AND (regexp_matches({_cut(1)}, '{twice}') OR (regexp_matches({_cut(1)}, '{single}')
              AND NOT regexp_matches({_cut(1)}, '{short}'))) THEN {_cut(1)} ELSE w END AS w FROM {n}_6),
    {n} AS (SELECT term, CASE WHEN NOT regexp_full_match(term, '[a-z][a-z][a-z]+') THEN term
              WHEN w LIKE '%ll' AND regexp_matches(w, '{twice}') THEN lower({_cut(1)}) ELSE lower(w) END AS stem FROM {n}_7)"""
