"""Set commands over all keys: (key, member) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BY = ["key", "member"]


def sadd(members: DataFrame, adds: DataFrame) -> DataFrame:
    """The members after the adds, each once."""
    return members.select(BY).unionByName(adds.select(BY)).distinct()


def added(adds: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(key, added): how many distinct members of the adds are new."""
    new = adds.select(BY).distinct()
    if members is not None:
        new = new.join(members, BY, "left_anti")
    return new.groupBy("key").agg(F.count("*").alias("added"))


def srem(members: DataFrame, removals: DataFrame) -> DataFrame:
    """The members that stay. An emptied set has no rows here; its key stays in the key table."""
    return members.join(removals, BY, "left_anti")


def srem_count(members: DataFrame, removals: DataFrame) -> DataFrame:
    """(key, removed): how many members were there."""
    return members.select(BY).distinct().join(removals, BY, "left_semi").groupBy("key").agg(F.count("*").alias("removed"))


def smembers(members: DataFrame) -> DataFrame:
    return members.select(BY).distinct()


def scard(members: DataFrame) -> DataFrame:
    return members.select(BY).distinct().groupBy("key").agg(F.count("*").alias("card"))


def sismember(members: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (key, member) with found, 1 or 0."""
    there = members.select(BY).distinct().withColumn("_there", F.lit(1))
    return probes.select(BY).join(there, BY, "left").select(*BY, F.coalesce("_there", F.lit(0)).alias("found"))
