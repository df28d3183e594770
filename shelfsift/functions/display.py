"""Display formats and highlight clean-up."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the standard with their characters; those without a semicolon also count at the start of a longer word.
ENTITIES = {name: characters for name, characters in html5.items() if name.endswith(";")}
BARE_ENTITIES = {name: characters for name, characters in html5.items() if not name.endswith(";")}
_REFERENCE = r"&(?:#[0-9]+;?+|#[xX][0-9a-fA-F]+;?+|[^\t\n\f <&#;]{1,32}+;?+)"
_PIECE = _REFERENCE + r"|[^&]++|&"
_BARE_NAME = "^(?:" + "|".join(sorted(BARE_ENTITIES, key=len, reverse=True)) + ")"

_REPLACED = "\ufffd"
# Numbers that stand for other characters: the bytes 0x80 to 0x9f as Windows reads them, zero and carriage return.
OTHER_NUMBERS = {b: bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0)} | {0: _REPLACED, 0x0D: "\r"}


def _literal_map(entries: dict) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, entries)), F.array(*map(F.lit, entries.values())))


def _numbered(piece: Column) -> Column:
    """The character of a numeric reference; '' for numbers that stand for none."""
    digits = F.regexp_extract(piece, r"^&#[xX]?0*([0-9a-fA-F]*);?$", 1)
    hexadecimal = piece.rlike("^&#[xX]")
    written_number = F.when(digits == "", "0").otherwise(digits)
    value = F.when(hexadecimal, F.conv(written_number, 16, 10)).otherwise(F.conv(written_number, 10, 10)).cast("long")
    number = F.when(F.length(digits) > 8, 0x110000).otherwise(value)
    none = (
        number.between(0x1, 0x8) | number.between(0xE, 0x1F) | number.between(0x7F, 0x9F) | (number == 0xB)
        | number.between(0xFDD0, 0xFDEF) | ((number % 0x10000) >= 0xFFFE)
    )
    written = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return (
        F.when(number.isin(*OTHER_NUMBERS), F.element_at(_literal_map(OTHER_NUMBERS), number.cast("int")))
        .when(number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), _REPLACED)
        .when(none, "").otherwise(written)
    )


def _named(piece: Column) -> Column:
    """The characters of a named reference, else of the longest bare name that it starts with, else itself."""
    name = F.substring(piece, F.lit(2), F.length(piece))
    start = F.regexp_extract(name, _BARE_NAME, 0)
    bare = F.concat(
        F.try_element_at(_literal_map(BARE_ENTITIES), start), F.substring(name, F.length(start) + 1, F.length(name)))
    return F.coalesce(F.try_element_at(_literal_map(ENTITIES), name), bare, piece)


def unescape(text: Column) -> Column:
    """All character references of a text resolved in one pass; what a reference gives is not read again."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    resolved = F.transform(
        pieces, lambda p: F.when(p.rlike("^&#[0-9xX]"), _numbered(p)).when(p.rlike("^&."), _named(p)).otherwise(p))
    return F.when(F.contains(text, F.lit("&")), F.array_join(resolved, "")).otherwise(text)


def clean_highlight(value: Column) -> Column:
    """Undo character references, then turn the ``em`` marks into ``mark``."""
    out = unescape(F.coalesce(value, F.lit("")))
    out = F.replace(out, F.lit("<em>"), F.lit("<mark>"))
    return F.replace(out, F.lit("</em>"), F.lit("</mark>"))


def first_text(highlights: Column, keys: list[str], fallbacks: list[Column]) -> Column:
    """First filled highlight among ``keys``, else the first filled plain field, cleaned."""
    marked = [F.try_element_at(F.try_element_at(highlights, F.lit(k)), F.lit(1)) for k in keys]
    return clean_highlight(F.coalesce(*[F.when(c != "", c) for c in marked + fallbacks], F.lit("")))


def format_score(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.format_string("%.3f", value))


def format_price(value: Column) -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(value, 2)), F.lit("n/a"))


def format_percent(value: Column) -> Column:
    return F.when(value.isNull(), "n/a").otherwise(F.concat(F.format_string("%.1f", value), F.lit("%")))
