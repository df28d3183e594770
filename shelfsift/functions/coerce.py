"""Lenient reading of untyped JSON values.

A raw field is a pair of columns: ``kind`` is the JSON type as the VARIANT
reader sees it (it tells ``0`` from ``"0"``), ``text`` is the value as written,
with object keys still in file order (VARIANT sorts them). Truth tests depend
on the type, text on the order.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a number in a text, and words that mean yes.
NUMBER_PATTERN = r"\d+(?:\.\d+)?"
TRUE_WORDS = ["1", "true", "t", "yes", "y"]

_FALSE_VALUES = (
    r"\A(?:BOOLEAN:false|STRING:|ARRAY:\[\]|OBJECT:\{\}"
    r"|(?:BIGINT|DECIMAL|DOUBLE|FLOAT):-?0+(?:\.0*)?(?:[eE][-+]?\d+)?)\z"
)

# Control characters stand nowhere in JSON text as they are, so these two can stand in for an escaped backslash and an
# escaped quote. A string is then all that lies between two quotes.
_BACKSLASH, _QUOTE = "\x01", "\x02"
# Keys (with their colon) and strings, empty lists and objects, numbers and words.
_JSON_PIECE = r'"[^"]*+"\s*+:?+|\[\s*+\]|\{\s*+\}|-?+[0-9][0-9.eE+-]*+|true|false|null'


class Field(NamedTuple):
    kind: Column
    text: Column


def stage(df: DataFrame, fields: dict[str, Field]) -> tuple[DataFrame, dict[str, Field]]:
    """Add fields as plain columns, so that later uses refer to them instead of repeating them.

    The columns come out of a one-row generator: the optimizer moves neither
    filters nor expressions across it, so each line is decoded once.
    """
    columns = []
    for name, field in fields.items():
        columns += [field.kind.alias(f"{name}_kind"), field.text.alias(f"{name}_text")]
    out = df.select("*", F.inline(F.array(F.struct(*columns))))
    return out, {name: Field(F.col(f"{name}_kind"), F.col(f"{name}_text")) for name in fields}


def kind_of(variant: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, DECIMAL, DOUBLE, ARRAY, OBJECT or VOID; null when absent."""
    return F.regexp_extract(F.schema_of_variant(variant), "^[A-Z]+", 0)


def raw_field(variant: Column, texts: Column, key: str) -> Field:
    """One key of a JSON object."""
    return Field(
        kind_of(F.variant_get(variant, f"$.{key}", "variant")), F.try_element_at(texts, F.lit(key))
    )


def kinds_of(variant: Column) -> Column:
    """Keys of a JSON object with their kinds; null for anything else."""
    return F.transform_values(variant.try_cast("map<string,variant>"), lambda _, value: kind_of(value))


def known_field(kinds: Column, texts: Column, key: str) -> Field:
    """One key of a JSON object of which all kinds and texts are at hand."""
    return Field(F.try_element_at(kinds, F.lit(key)), F.try_element_at(texts, F.lit(key)))


def text_field(text: Column) -> Field:
    """A plain string column as a field."""
    return Field(F.when(text.isNull(), "VOID").otherwise("STRING"), text)


def missing(field: Field) -> Column:
    return field.kind.isNull() | (field.kind == "VOID")


def truthy(field: Field) -> Column:
    """Null, false, zero and empty text, list or object are false; everything else is true."""
    return F.coalesce(~F.concat(field.kind, F.lit(":"), field.text).rlike(_FALSE_VALUES), F.lit(False))


def first_truthy(*fields: Field) -> Field:
    """The first true field, else the last one as it is."""
    kind, text = fields[-1]
    for field in reversed(fields[:-1]):
        true = truthy(field)
        kind, text = F.when(true, field.kind).otherwise(kind), F.when(true, field.text).otherwise(text)
    return Field(kind, text)


def scalar_text(field: Field) -> Column:
    """The value as text; booleans are capitalised, a missing value stays null."""
    return F.when(field.kind == "BOOLEAN", F.initcap(field.text)).otherwise(field.text)


def _leaf_text(piece: Column) -> Column:
    """One value of a nested one: strings unescaped, booleans capitalised, nulls and empty lists and objects as ''."""
    inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
    written = F.replace(F.replace(inner, F.lit(_BACKSLASH), F.lit("\\\\")), F.lit(_QUOTE), F.lit('\\"'))
    decoded = F.from_json(F.concat(F.lit('["'), written, F.lit('"]')), "array<string>")[0]
    return (
        F.when(piece.startswith('"'), F.when(inner.rlike(r"[\x01\x02\\]"), decoded).otherwise(inner))
        .when(piece.isin("true", "false"), F.initcap(piece))
        .when((piece == "null") | piece.startswith("[") | piece.startswith("{"), "")
        .otherwise(piece)
    )


def nested_text(text: Column) -> Column:
    """Values of a JSON list or object joined by one blank in file order, whatever their depth.

    Joining level by level gives the same as joining all values in order, so one pass over the text does. Keys are the
    strings before a colon.
    """
    masked = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))
    pieces = F.regexp_extract_all(masked, F.lit(_JSON_PIECE), F.lit(0))
    values = F.filter(pieces, lambda p: ~(p.startswith('"') & p.endswith(":")))
    return F.array_join(F.transform(values, _leaf_text), " ")


def as_text(field: Field) -> Column:
    """Lists and objects joined by one blank in file order, nulls as '', at any depth."""
    nested = F.when(field.kind.isin("ARRAY", "OBJECT"), nested_text(field.text))
    return F.coalesce(nested, scalar_text(field), F.lit(""))


def number_from_text(text: Column, default: float = 0.0) -> Column:
    """First number written in a text, commas dropped, sign ignored."""
    found = F.regexp_extract(F.regexp_replace(text, ",", ""), NUMBER_PATTERN, 0)
    return F.coalesce(found.try_cast("double"), F.lit(float(default)))


def parse_number(field: Field, default: float = 0.0) -> Column:
    """Native numbers keep their sign; text goes through ``number_from_text``."""
    kind, text = field
    return (
        F.when(missing(field), F.lit(float(default)))
        .when(kind == "BOOLEAN", F.when(text == "true", 1.0).otherwise(0.0))
        .when(kind.isin("STRING", "ARRAY", "OBJECT"), number_from_text(text, default))
        .otherwise(text.try_cast("double"))
    )


def bool_from_text(text: Column, default: bool = False) -> Column:
    return F.when(text.isNull(), F.lit(default)).otherwise(
        F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")).isin(TRUE_WORDS)
    )


def parse_count(field: Field) -> Column:
    """The number without its fraction; null where no long holds it."""
    return parse_number(field).try_cast("long")


def parse_bool(field: Field, default: bool = False) -> Column:
    kind, text = field
    return (
        F.when(missing(field), F.lit(default))
        .when(kind.isin("BOOLEAN", "STRING", "ARRAY", "OBJECT"), bool_from_text(text, default))
        .otherwise(text.try_cast("double") != 0)
    )


def digits_to_long(text: Column) -> Column:
    """A value made of digits only, else null."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long"))


def epoch_to_timestamp(epoch: Column) -> Column:
    """Epoch milliseconds from 1e11 on, seconds below."""
    return F.when(epoch >= F.lit(100_000_000_000), F.timestamp_millis(epoch)).otherwise(
        F.timestamp_seconds(epoch)
    )


def first_nonempty(*texts: Column) -> Column:
    """First text that is neither null nor ''."""
    return F.coalesce(*[F.when(t != "", t) for t in texts])


def first_nonzero(*numbers: Column) -> Column:
    """First number that is neither null nor 0."""
    return F.coalesce(*[F.when(n != 0, n) for n in numbers])


def all_of(predicates: list[Column]) -> Column:
    """Conjunction; true when there is nothing to test."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))
