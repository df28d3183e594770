"""Row predicates of the search parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfsift.functions.coerce import all_of

# Phrases that make a review query a positive one.
POSITIVE_PHRASES = ["good", "great", "excellent", "easy", "quality", "works well", "install"]
POSITIVE_FROM = 4
NEGATIVE_TO = 2


@dataclass(frozen=True)
class ProductFilter:
    """Optional search parameters; what is not given does not filter. Ranges include both ends."""

    brand: str | None = None
    category: str | None = None
    min_price: float | None = None
    max_price: float | None = None
    min_rating: float | None = None

    def predicate(self) -> Column:
        tests = []
        if self.brand:
            tests.append(F.col("brand") == self.brand)
        if self.category:
            tests.append(F.col("category") == self.category)
        if self.min_price is not None:
            tests.append(F.col("price") >= float(self.min_price))
        if self.max_price is not None:
            tests.append(F.col("price") <= float(self.max_price))
        if self.min_rating is not None:
            tests.append(F.col("rating") >= float(self.min_rating))
        return all_of(tests)


def equals(values: dict[str, object], allowed: list[str]) -> Column:
    """Equality on attributes a collection allows to filter by."""
    unknown = [name for name in values if name not in allowed]
    if unknown:
        raise ValueError(f"not filterable: {unknown}; choose from {allowed}")
    return all_of([F.col(name) == F.lit(value) for name, value in values.items()])


def is_positive(query: Column) -> Column:
    """True when any of the phrases occurs anywhere in the query, also inside words."""
    lowered = F.lower(query)
    found = F.lit(False)
    for phrase in POSITIVE_PHRASES:
        found = found | F.contains(lowered, F.lit(phrase))
    return found


def sentiment(query: Column) -> Column:
    return F.when(is_positive(query), "positive").otherwise("negative")


def rating_fits(query: Column, rating: Column) -> Column:
    """Positive queries look at ratings from 4 up, all others at ratings up to 2."""
    return F.when(is_positive(query), rating >= POSITIVE_FROM).otherwise(rating <= NEGATIVE_TO)
