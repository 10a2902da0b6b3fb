"""Hash commands over all keys: (key, field, value) rows, the last write of a field wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.functions.reduce import newest

BY = ["key", "field"]


def hset(writes: DataFrame, order: list[str]) -> DataFrame:
    """(key, field, value) after the writes (key, field, value, order...)."""
    return newest(writes, BY, order, ["value"])


def hset_over(fields: DataFrame, writes: DataFrame, order: list[str]) -> DataFrame:
    """The fields after the writes."""
    new = hset(writes, order)
    return fields.select(*BY, "value").join(new, BY, "left_anti").unionByName(new)


def new_fields(writes: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(key, added): distinct fields of the writes that weren't there."""
    new = writes.select(BY).distinct()
    if fields is not None:
        new = new.join(fields, BY, "left_anti")
    return new.groupBy("key").agg(F.count("*").alias("added"))


def hget(fields: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (key, field) with value, null where there is none."""
    return probes.select(BY).join(fields.select(*BY, "value"), BY, "left")


def hdel(fields: DataFrame, removals: DataFrame) -> DataFrame:
    return fields.join(removals, BY, "left_anti")


def hdel_count(fields: DataFrame, removals: DataFrame) -> DataFrame:
    return fields.select(BY).join(removals, BY, "left_semi").groupBy("key").agg(F.count("*").alias("deleted"))


def hkeys(fields: DataFrame) -> DataFrame:
    return fields.select(BY)


def hvalues(fields: DataFrame) -> DataFrame:
    return fields.select("key", "value")


def hentries(fields: DataFrame) -> DataFrame:
    return fields.select(*BY, "value")


def as_map(fields: DataFrame) -> DataFrame:
    """(key, entries map): a nested view for hashes known to be small."""
    return fields.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("entries"))
