"""Row order without a single task: first-n, per-key first-n, top-k per query, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfsift.operators.sizes import materialized

# Up to this many rows Spark's own top-n (a bounded heap per task) is the best plan.
SMALL_LIMIT = 1000


def dealt(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows dealt out by ranges of the order, with their range as ``_part``; kept, so that all later steps see one dealing.

    Spark samples quantiles for the borders: neither outliers nor clumps of values make a range much larger than
    others, and any type can be ordered. Only rows alike in the whole order stay together.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialized(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))


def _rows_before(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(range, rows in earlier ones, its own rows), in order; a row per range comes to the driver."""
    sizes = sorted(map(tuple, rows.groupBy("_part").agg(F.count(F.lit(1))).collect()))
    found, before = [], 0
    for part, n in sizes:
        found.append((part, before, n))
        before += n
    return found


def first_n(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows by a unique column.

    For a large ``n`` only the column is dealt out, to find the last value
    wanted; then the rows up to it pass where they are.
    """
    if n <= SMALL_LIMIT:
        return df.orderBy(order).limit(max(n, 0))
    keys = dealt(df.select(order), order)
    holder = [(part, n - before) for part, before, size in _rows_before(keys) if before < n <= before + size]
    if not holder:
        return df
    part, nth = holder[0]
    last = keys.filter(F.col("_part") == part).orderBy(order).offset(nth - 1).limit(1).first()[0]
    if isinstance(last, Row):
        last = F.struct(*(F.lit(value).alias(name) for name, value in last.asDict().items()))
    return df.filter(F.col(order) <= last)


def numbered(df: DataFrame, order: str, name: str = "row_no") -> DataFrame:
    """A global 1-based row number by a unique column, ranked range by range."""
    return _numbered(df, [F.col(order)], name)


def _numbered(df: DataFrame, order: list[Column], name: str, first: int = 1, last: int | None = None) -> DataFrame:
    """Rows of the ranges that hold the numbers from ``first`` to ``last``, with their number."""
    rows = dealt(df, *order)
    held = [(part, before) for part, before, n in _rows_before(rows) if before + n >= first and (last is None or before < last)]
    before = F.broadcast(df.sparkSession.createDataFrame(held, "_part int, _before long"))  # a row per range
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return rows.join(before, "_part").withColumn(name, local + F.col("_before")).drop("_part", "_before")


def pages(df: DataFrame, order: str, size: int) -> DataFrame:
    """Every row with the page it falls on (0-based)."""
    return numbered(df, order).withColumn("page", F.floor((F.col("row_no") - 1) / size))


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One 1-based page of an ordered table.

    The first pages come from a bounded heap per task; a deep one from the
    ranges that hold it, the others are only counted.
    """
    first, last = (page - 1) * size + 1, page * size
    if last <= SMALL_LIMIT:
        return df.orderBy(*order).offset(first - 1).limit(size)
    rows = _numbered(df, order, "_no", first, last)
    return rows.filter(F.col("_no").between(first, last)).orderBy("_no").drop("_no")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int | None = 1) -> DataFrame:
    """First ``n`` rows per key; ``None`` or 0 lifts the cap.

    The rank filter lets Spark drop rows beyond ``n`` before the shuffle, so a
    hot key sends at most ``n`` rows per input task.
    """
    if not n:
        return df
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def top_k(df: DataFrame, k: int, order: list[Column], by: str = "query_id") -> DataFrame:
    """Ranked first ``k`` rows per query, as column ``rank``."""
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def match_totals(df: DataFrame, by: str = "query_id", cap: int | None = None) -> DataFrame:
    """Number of matches per query, counted map-side first; ``cap`` bounds the reported number.

    Scored matches are counted by their score: the count then needs the same
    columns as the page of hits, and both read one exchange instead of matching twice.
    """
    total = F.count("score") if "score" in df.columns else F.count(F.lit(1))
    if cap is not None:
        total = F.least(total, F.lit(cap).cast("long"))
    return df.groupBy(by).agg(total.alias("total"))


def page_with_total(df: DataFrame, k: int, order: list[Column], by: str = "query_id") -> DataFrame:
    """Top ``k`` per query next to the total of all its matches."""
    return top_k(df, k, order, by).join(match_totals(df, by), by)


def checked_limit(limit: int, low: int = 1, high: int = 50) -> int:
    if not low <= limit <= high:
        raise ValueError(f"limit must be between {low} and {high}, not {limit}")
    return limit


def checked_query(text: str | None) -> str:
    cleaned = (text or "").strip()
    if not cleaned:
        raise ValueError("a query text is required")
    return cleaned


def nonempty_queries(queries: DataFrame) -> DataFrame:
    """Queries with their text trimmed; blank ones are dropped."""
    trimmed = F.trim(F.coalesce(F.col("q"), F.lit("")))
    return queries.withColumn("q", trimmed).filter(F.col("q") != "")


def sort_column(name: str, allowed: list[str], descending: bool = True) -> Column:
    if name not in allowed:
        raise ValueError(f"{name} is not sortable; choose from {allowed}")
    return F.desc(name) if descending else F.asc(name)
