"""Column helpers that the operators share: newest wins, visibility, index rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """One row for each `by`: the values of the row that is last in `order`.

    A grouped max_by: partial results are formed before the shuffle, so a hot key sends one row per task.
    """
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_last")
    return df.groupBy(*by).agg(last).select(*by, *[F.col(f"_last.{v}").alias(v) for v in values])


def visible(now: int | Column, deleted: str = "deleted", expire_time: str = "expire_time") -> Column:
    """Neither removed nor expired: a value is still there in the second of its deadline; 0 is no deadline."""
    now = F.lit(now) if isinstance(now, int) else now
    return ~F.col(deleted) & ((F.col(expire_time) == 0) | (F.col(expire_time) >= now))


def seconds(ts: str = "ts") -> Column:
    """Whole seconds since the epoch; timestamps without zone are taken as UTC by the session."""
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def full_match(column: Column, pattern: str) -> Column:
    """Whether the whole string matches; a plain rlike would accept a part, and $ a final line break."""
    return column.rlike(rf"\A(?:{pattern})\z")


def index_bounds(start: int, end: int, size: Column) -> tuple[Column, Column]:
    """(first, last) of an inclusive range of indexes: negative ones count from the end, then both are clamped."""
    first = F.lit(start) if start >= 0 else size + F.lit(start)
    last = F.lit(end) if end >= 0 else size + F.lit(end)
    return F.greatest(first, F.lit(0)).cast("bigint"), F.least(last, size - 1).cast("bigint")


def six_places(x: Column) -> Column:
    """How an incremented score is written."""
    return F.format_string("%.6f", x)
