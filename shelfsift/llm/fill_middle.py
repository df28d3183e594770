"""Fill-in-middle: texts cut in three and set out anew, with a sparse index of the characters of several bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsift.llm.common import map_frames

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, CHANGED, SUFFIX_FIRST = 42, 50, 80


class SparseIndex:
    """Code-point and byte places of a UTF-8 text.

    Only the characters of several bytes are recorded, with their code-point position and the bytes that they and those
    before them take beyond one each. Wherever a place lies, the last exception before it tells the difference of the
    two counts; a text of one byte per character has no exceptions and both places are the same number.
    """

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        leads = np.flatnonzero(raw >= 0xC0)
        kinds = raw[leads]
        extra = 1 + (kinds >= 0xE0).astype(np.int64) + (kinds >= 0xF0)
        through = np.cumsum(extra)
        self.size = len(raw)
        self.characters = leads - (through - extra)
        self.excess = np.concatenate([[0], through])

    def to_bytes(self, places) -> np.ndarray:
        """Byte places of code-point places."""
        places = np.asarray(places, np.int64)
        return places + self.excess[np.searchsorted(self.characters, places)]

    def to_characters(self, places) -> np.ndarray:
        """Code-point places of byte places, which lie between characters."""
        places = np.asarray(places, np.int64)
        starts = self.characters + self.excess[:-1]
        return places - self.excess[np.searchsorted(starts, places)]

    def __len__(self) -> int:
        """Code points of the text."""
        return int(self.size - self.excess[-1])


def token_ends(data: bytes) -> np.ndarray:
    """Byte places at which tokens end: words with the white space before them, then white space at the text's end."""
    raw = np.frombuffer(data, np.uint8)
    white = (raw == 0x20) | ((raw >= 0x09) & (raw <= 0x0D))
    ends = np.flatnonzero(~white & np.append(white[1:], True)[:len(raw)]) + 1
    return np.append(ends, len(raw)) if len(raw) and white[-1] else ends


def _cut(data: bytes, form: str, unit: str, first: int, second: int) -> tuple:
    """(n, prefix_chars, middle_chars, output) of one text."""
    index = SparseIndex(data)
    ends = token_ends(data) if unit == "token" else None
    n = len(index) if ends is None else len(ends)
    if form == "plain":
        return n, None, None, data
    a, b = sorted((first % (n + 1), second % (n + 1)))
    if ends is None:
        characters = [a, b]
        x, y = index.to_bytes(characters).tolist()
    else:
        x, y = (int(ends[k - 1]) if k else 0 for k in (a, b))
        characters = index.to_characters([x, y]).tolist()
    prefix, middle, suffix = data[:x], data[x:y], data[y:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    parts = (p, prefix, s, suffix, m, middle) if form == "psm" else (s, suffix, p, prefix, m, middle)
    return n, characters[0], characters[1] - characters[0], b"".join(parts)


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from the digest of the seed and the key; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def rearrange(
    docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "token",
    seed: int = SEED, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """One row per document: ``key``, n, form, prefix_chars, middle_chars, output.

    Every whole text is cut at two drawn places, between tokens or characters as ``unit`` says; n counts those units.
    Of 100 texts ``changed`` are set out anew, ``suffix_first`` of 100 of them as suffix, prefix, middle (spm), the others
    as prefix, suffix, middle (psm). The rest, empty texts and texts that hold a mark stay as they are (plain, with
    null cuts). A null text is an empty one. Cuts hang on the key alone, so rows of one key (or of a null one) are cut by
    the same draws. Row by row without a shuffle, whatever the key's share; very long texts take memory in proportion.
    Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    if unit not in ("token", "character"):
        raise ValueError(f"unit must be token or character, not {unit}")
    own = F.coalesce(F.col(text), F.lit(""))
    h = draws(F.col(key), seed)
    marked = F.contains(own, F.lit(PREFIX)) | F.contains(own, F.lit(SUFFIX)) | F.contains(own, F.lit(MIDDLE))
    form = (
        F.when((own == "") | marked | (h[2] % 100 >= changed), "plain")
        .when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    )
    rows = docs.select(
        F.col(key).alias("key"), own.cast("binary").alias("data"), form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cut = [_cut(bytes(d), form, unit, a, b) for d, form, a, b in zip(f["data"], f["form"], f["h1"], f["h2"])]
            n, before, between, out = zip(*cut) if cut else ((), (), (), ())
            yield pd.DataFrame({
                "key": f["key"], "n": n, "form": f["form"], "prefix_chars": pd.array(before, "Int64"),
                "middle_chars": pd.array(between, "Int64"), "output": pd.Series(out, f.index, object)})

    found = map_frames(
        rows, ["key"], run, "n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.select(
        F.col("key").alias(key), "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``rearrange`` set out, from its output and form: texts with marks are plain, so marks part the rest."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)
    )
