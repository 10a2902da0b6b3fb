"""Sorted-set commands over all keys: (key, member, score) rows ordered by score, then member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.functions.reduce import index_bounds, newest, six_places
from keyfold.operators.order import numbered

BY = ["key", "member"]


def zadd(writes: DataFrame, order: list[str]) -> DataFrame:
    """(key, member, score), and score_text if the writes have it, after the writes: the last score of a member holds."""
    return newest(writes, BY, order, _scores(writes))


def _scores(z: DataFrame) -> list[str]:
    return [c for c in ("score", "score_text") if c in z.columns]


def zadd_count(writes: DataFrame) -> DataFrame:
    """(key, added): the pairs supplied, as the command answers."""
    return writes.groupBy("key").agg(F.count("*").alias("added"))


def zrem(z: DataFrame, removals: DataFrame) -> DataFrame:
    return z.join(removals, BY, "left_anti")


def zscore(z: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (key, member) with score, null where there is none; with score_text, the score as it was written, if z has it."""
    return probes.select(BY).join(z.select(*BY, *_scores(z)), BY, "left")


def zcard(z: DataFrame) -> DataFrame:
    return z.groupBy("key").agg(F.count("*").alias("card"))


def ranked(z: DataFrame) -> DataFrame:
    """z with rank from 0. Large sets are sorted by parts, whatever their scores (see order)."""
    return numbered(z, "key", ["score", "member"], "rank")


def zrank(z: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, member, rank) of the probes that are members. Sets without a probe are not ranked."""
    asked = probes.select(BY).distinct()
    return ranked(z.join(asked.select("key").distinct(), "key", "left_semi")).join(asked, BY, "left_semi").select(*BY, "rank")


def zrange_by_rank(z: DataFrame, start: int, end: int) -> DataFrame:
    """z's rows with rank from start to end, both inclusive; negative ones count from the end.

    Ranges from the front or from the back keep only the rows that can be in it before they are shuffled;
    others need the sizes of the sets.
    """
    up, down = W.partitionBy("key").orderBy("score", "member"), W.partitionBy("key").orderBy(F.desc("score"), F.desc("member"))
    if start >= 0 and end >= 0:
        out = z.withColumn("_r", F.row_number().over(up) - 1).where(F.col("_r") <= end)
        return out.where(F.col("_r") >= start).withColumn("rank", F.col("_r").cast("bigint")).drop("_r")
    if start < 0 and end < 0:
        out = z.withColumn("_b", F.row_number().over(down)).where(F.col("_b") <= -start)
        sizes = zcard(z)
        return out.where(F.col("_b") >= -end).join(sizes, "key").withColumn("rank", F.col("card") - F.col("_b")).drop("_b", "card")
    first, last = index_bounds(start, end, F.col("card"))
    return ranked(z).join(zcard(z), "key").where(F.col("rank").between(first, last)).drop("card")


def zrange_by_score(z: DataFrame, low: float, high: float) -> DataFrame:
    """z's rows with a score from low to high, both inclusive, by number."""
    return z.where(F.col("score").between(low, high))


def zrem_by_rank(z: DataFrame, start: int, end: int) -> DataFrame:
    """z without the ranks from start to end."""
    return z.join(zrange_by_rank(z, start, end).select(BY), BY, "left_anti")


def zrem_by_score(z: DataFrame, low: float, high: float) -> DataFrame:
    return z.where(~F.col("score").between(low, high))


def zincr_by(z: DataFrame, increments: DataFrame) -> DataFrame:
    """(key, member, score, score_text) of the members that get increments (key, member, by); the sums are
    formed as decimals, so their order doesn't matter. Increments of members that aren't there do nothing."""
    sums = increments.groupBy(BY).agg(F.sum(F.col("by").cast("decimal(28,8)")).alias("_by"))
    new = (F.col("score").cast("decimal(28,8)") + F.col("_by")).cast("double")
    return z.join(sums, BY).select(*BY, new.alias("score"), six_places(new).alias("score_text"))
