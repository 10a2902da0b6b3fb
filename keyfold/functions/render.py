"""Values as text: (key, text). A value becomes one string, so this is for values known to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _joined(rows: DataFrame, order: Column, item: Column, between: str, left: str, right: str) -> DataFrame:
    """Items of each key in order, between brackets."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), item.alias("i")))), lambda x: x["i"])
    return rows.groupBy("key").agg(F.concat(F.lit(left), F.array_join(items, between), F.lit(right)).alias("text"))


def lists(rows: DataFrame) -> DataFrame:
    """[a,b] in the order of positions."""
    return _joined(rows, F.col("pos"), F.col("value"), ",", "[", "]")


def sets(rows: DataFrame) -> DataFrame:
    """(a,b) in byte order."""
    return _joined(rows, F.col("member"), F.col("member"), ",", "(", ")")


def hashes(rows: DataFrame) -> DataFrame:
    """{field: value, ...} in byte order of the fields."""
    return _joined(rows, F.col("field"), F.concat_ws(": ", "field", "value"), ", ", "{", "}")


def zsets(rows: DataFrame) -> DataFrame:
    """zset(member=score, ...) by score, then member; the score as it was written."""
    return _joined(rows, F.struct("score", "member"), F.concat_ws("=", "member", "score_text"), ", ", "zset(", ")")
