"""Commands on keys of any type, for all keys at once: get, exists, remove, keys, range, expire, set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.functions.reduce import full_match, newest, visible

STATE = ["value", "deleted", "expire_time", "ts", "seq"]


def latest(versions: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The newest version of every key by (ts, seq), removed and expired ones included."""
    values = columns or [c for c in versions.columns if c not in ("key", "ts", "seq")]
    return newest(versions, ["key"], ["ts", "seq"], [*values, "ts", "seq"])


def get(versions: DataFrame, now: int = 0, keys: DataFrame | None = None) -> DataFrame:
    """The visible values, of the given keys or of all; the newest version decides, even if it is a tombstone.

    now = 0 looks at tombstones alone. Keys are cut down before versions are reduced.
    """
    if keys is not None:
        versions = versions.join(keys.select("key").distinct(), "key", "left_semi")
    found = latest(versions)
    return found.where(visible(now) if now else ~F.col("deleted"))


def exists(kv: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (key) with found, 1 or 0."""
    there = kv.select("key").distinct().withColumn("_there", F.lit(True))
    return probes.join(there, "key", "left").withColumn("found", F.col("_there").isNotNull().cast("int")).drop("_there")


def remove(kv: DataFrame, requests: DataFrame) -> DataFrame:
    """kv without the requested keys. The command's own result is the number of requests, see removed()."""
    return kv.join(requests.select("key"), "key", "left_anti")


def removed(requests: DataFrame) -> DataFrame:
    """One row: every requested key counts, there or not."""
    return requests.agg(F.count("*").alias("removed"))


def tombstones(requests: DataFrame) -> DataFrame:
    """requests (key, ts, seq) as versions that remove."""
    return requests.select("key", F.lit(None).cast("string").alias("value"), F.lit(True).alias("deleted"), F.lit(0).cast("bigint").alias("expire_time"), "ts", "seq")


def keys(kv: DataFrame, pattern: str = ".*") -> DataFrame:
    """The distinct live keys that match as a whole, in byte order."""
    return kv.select("key").where(full_match(F.col("key"), pattern)).distinct().orderBy("key")


def key_range(kv: DataFrame, start: str, end: str) -> DataFrame:
    """Keys from start to end, both inclusive, in byte order; the condition reaches the files' statistics."""
    return kv.where(F.col("key").between(start, end)).orderBy("key")


def set_values(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """versions with the values of requests (key, value, ttl seconds or null, ts, seq) on top: a deadline is
    counted from the request's ts, so it is the same wherever it is applied."""
    ttl = F.coalesce("ttl", F.lit(0))
    deadline = F.when(ttl > 0, F.unix_seconds("ts") + ttl).otherwise(0).cast("bigint")
    new = requests.select("key", F.col("value").cast("string").alias("value"), F.lit(False).alias("deleted"), deadline.alias("expire_time"), "ts", "seq")
    return versions.select("key", *STATE).unionByName(new)


def expire(state: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, responses): deadlines of requests (key, ttl, ts) set on state (key, deleted, expire_time, ...).

    0 clears a deadline; a missing key is an error; a removed or expired value is left alone, without one.
    """
    ask = newest(requests.withColumn("_n", F.monotonically_increasing_id()), ["key"], ["ts", "_n"], ["ttl", "ts"]).withColumnsRenamed({"ttl": "_ttl", "ts": "_at"})
    at = F.unix_seconds("_at")
    new = F.when(F.col("_ttl").isNotNull() & visible(at), F.when(F.col("_ttl") > 0, at + F.col("_ttl")).otherwise(0)).otherwise(F.col("expire_time")).cast("bigint")
    out = state.join(ask, "key", "left").withColumn("expire_time", new).drop("_ttl", "_at")
    known = state.select("key").distinct().withColumn("_there", F.lit(True))
    code = F.col("_there").isNotNull().cast("int")
    responses = requests.join(known, "key", "left").select("key", code.alias("code"), F.when(code == 0, "key not found").alias("error"))
    return out, responses
