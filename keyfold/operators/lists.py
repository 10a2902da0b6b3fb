"""List commands over all keys: (key, pos, value) rows.

The positions of a list are a run of whole numbers without gaps. Pushing to the front goes below the
first, pushing to the back above the last, popping cuts off an end: nothing is ever numbered anew, and an
index is a position relative to the list's first one. So no command sorts a list; each needs only the
ends of the lists, a grouped aggregation, and a filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.functions.reduce import index_bounds
from keyfold.operators.order import numbered


def ends(lists: DataFrame) -> DataFrame:
    """(key, first, last, size)."""
    out = lists.groupBy("key").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return out.withColumn("size", F.col("last") - F.col("first") + 1)


def _pushed(pushes: DataFrame, order: list[str]) -> DataFrame:
    """pushes (key, value, order...) with n from 1. Only new values are sorted, those of a large list by parts (see order)."""
    return numbered(pushes, "key", order, "n").withColumn("n", F.col("n") + 1)


def rpush(lists: DataFrame | None, pushes: DataFrame, order: list[str]) -> DataFrame:
    """The lists with the pushes at the back, in their order."""
    new = _pushed(pushes, order)
    if lists is None:
        return new.select("key", (F.col("n") - 1).alias("pos"), "value")
    placed = new.join(ends(lists), "key", "left").select("key", (F.coalesce("last", F.lit(-1)) + F.col("n")).alias("pos"), "value")
    return lists.select("key", "pos", "value").unionByName(placed)


def lpush(lists: DataFrame | None, pushes: DataFrame, order: list[str]) -> DataFrame:
    """The lists with the pushes at the front, one after another, so that the last one comes first."""
    new = _pushed(pushes, order)
    if lists is None:
        return new.select("key", (-F.col("n")).alias("pos"), "value")
    placed = new.join(ends(lists), "key", "left").select("key", (F.coalesce("first", F.lit(0)) - F.col("n")).alias("pos"), "value")
    return lists.select("key", "pos", "value").unionByName(placed)


def lrange(lists: DataFrame, start: int, end: int) -> DataFrame:
    """(key, index, value) from start to end, both inclusive; negative indexes count from the back."""
    first, last = index_bounds(start, end, F.col("size"))
    at = F.col("pos") - F.col("first")
    return lists.join(ends(lists), "key").where(at.between(first, last)).select("key", at.alias("index"), "value")


def lget(lists: DataFrame, index: int) -> DataFrame:
    """(key, value) at an index, for lists that have it."""
    wanted = F.col("first") + index if index >= 0 else F.col("last") + 1 + index
    return lists.join(ends(lists), "key").where(F.col("pos") == wanted).select("key", "value")


def lsize(lists: DataFrame) -> DataFrame:
    return ends(lists).select("key", "size")


def lpop(lists: DataFrame, n: int = 1) -> DataFrame:
    """(key, nth, value): the up to n values popped from the front, nth from 1."""
    nth = F.col("pos") - F.col("first") + 1
    return lists.join(ends(lists), "key").where(nth <= n).select("key", nth.alias("nth"), "value")


def rpop(lists: DataFrame, n: int = 1) -> DataFrame:
    """(key, nth, value): the up to n values popped from the back, the last first."""
    nth = F.col("last") - F.col("pos") + 1
    return lists.join(ends(lists), "key").where(nth <= n).select("key", nth.alias("nth"), "value")


def after_lpop(lists: DataFrame, n: int = 1) -> DataFrame:
    return lists.join(ends(lists), "key").where(F.col("pos") - F.col("first") >= n).select("key", "pos", "value")


def after_rpop(lists: DataFrame, n: int = 1) -> DataFrame:
    return lists.join(ends(lists), "key").where(F.col("last") - F.col("pos") >= n).select("key", "pos", "value")
