"""Versions in layers: merging, compaction, snapshots.

A layer is a DataFrame of versions (key, ..., deleted, expire_time, ts, seq) with a `layer` ordinal, larger
is newer. The newest version by (ts, seq) decides, whatever layer it comes from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfold.config import Settings
from keyfold.functions.reduce import visible
from keyfold.operators.keyspace import latest


def stacked(layers: list[DataFrame]) -> DataFrame:
    """All layers, oldest first, as one DataFrame with `layer`."""
    return reduce(DataFrame.unionByName, [d.withColumn("layer", F.lit(i)) for i, d in enumerate(layers)])


def merge(layers: DataFrame, now: int = 0) -> DataFrame:
    """The visible state of all layers: what a read sees, and a compaction of all layers into one."""
    return latest(layers).where(visible(now) if now else ~F.col("deleted"))


def range_read(layers: DataFrame, start: str, end: str, now: int = 0) -> DataFrame:
    """The visible versions of keys from start to end, both inclusive, over all layers, in byte order. The range is below
    the merge, so it reaches each layer's files."""
    return merge(layers.where(F.col("key").between(start, end)), now).orderBy("key")


def compact(layers: DataFrame, settings: Settings, level: int = 0, now: int = 0) -> DataFrame:
    """One step of the compaction that the settings ask for."""
    if settings.merge_strategy == "leveled":
        return compact_leveled(layers, level, now)
    return compact_size_tiered(layers, settings.merge_threshold, now)


def compact_size_tiered(layers: DataFrame, threshold: int = 5, now: int = 0) -> DataFrame:
    """Layers of a level that has `threshold` or more of them become one layer a level up: newest versions only.

    layers has `level` too. Tombstones and expired versions go only when no other layer is left below, for an
    older copy could come back otherwise; (key, ..., layer, level) of all that remains.
    """
    per_level = layers.select("level", "layer").distinct().groupBy("level").agg(F.count("*").alias("_n"), F.max("layer").alias("_top"))
    full = F.broadcast(per_level.where(F.col("_n") >= threshold))  # a row for each level
    deepest = F.broadcast(layers.agg(F.max("level").alias("_deepest")))
    moving = layers.join(full, "level").withColumn("level", F.col("level") + 1).withColumn("layer", F.col("_top")).drop("_n", "_top")
    staying = layers.join(full, "level", "left_anti")
    values = [c for c in layers.columns if c not in ("key", "ts", "seq", "level", "layer")]
    last = F.max_by(F.struct(*values, "ts", "seq"), F.struct("ts", "seq")).alias("_v")
    merged = moving.groupBy("key", "level", "layer").agg(last).select("key", "_v.*", "level", "layer").crossJoin(deepest)
    alive = visible(now) if now else ~F.col("deleted")
    kept = merged.where(alive | (F.col("_deepest") >= F.col("level"))).drop("_deepest")
    return staying.unionByName(kept.select(staying.columns))


def extents(layers: DataFrame) -> DataFrame:
    """(layer, level, min_key, max_key, entry_count) of every layer."""
    return layers.groupBy("layer", "level").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("entry_count"))


def overlapping(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """(layer, other): layers of the next level whose key range meets that of a layer. One row for each file
    on either side, so comparing all of them is small."""
    u = upper.select("layer", "level", "min_key", "max_key")
    v = lower.select(F.col("layer").alias("other"), F.col("level").alias("_l"), F.col("min_key").alias("_lo"), F.col("max_key").alias("_hi"))
    meets = (F.col("_l") == F.col("level") + 1) & (F.col("min_key") <= F.col("_hi")) & (F.col("_lo") <= F.col("max_key"))
    return u.join(v, meets).select("layer", "other")


def compact_leveled(layers: DataFrame, level: int, now: int = 0, files: DataFrame | None = None) -> DataFrame:
    """The oldest layer of a level and the layers of the next one that it overlaps, merged into the next level.

    files: extents() as kept since the layers were written; without it all keys are read to find them.
    """
    files = extents(layers) if files is None else files
    oldest = files.where(F.col("level") == level).orderBy("layer").limit(1)
    chosen = oldest.select("layer").unionByName(overlapping(oldest, files).select(F.col("other").alias("layer")))
    moving = layers.join(F.broadcast(chosen), "layer", "left_semi")
    staying = layers.join(F.broadcast(chosen), "layer", "left_anti")
    new = latest(moving.drop("layer", "level"))
    below = F.broadcast(staying.agg(F.max("level").alias("_deepest")))
    alive = visible(now) if now else ~F.col("deleted")
    kept = new.crossJoin(below).where(alive | (F.coalesce("_deepest", F.lit(-1)) > level)).drop("_deepest")
    top = F.broadcast(oldest.select("layer"))
    return staying.unionByName(kept.crossJoin(top).withColumn("level", F.lit(level + 1)).select(staying.columns))


def snapshot(log: DataFrame, up_to: int) -> DataFrame:
    """The newest version of every key among operations with seq <= up_to: tombstones stay."""
    return latest(log.where(F.col("seq") <= up_to))


def snapshot_and_tail(snap: DataFrame, log: DataFrame, after: int) -> DataFrame:
    """The state after a snapshot and the operations behind it; the same as replaying the whole log."""
    return merge(snap.unionByName(log.where(F.col("seq") > after).select(snap.columns)))


def stats(layers: DataFrame) -> DataFrame:
    """(layer, entries, tombstones, key_bytes) of every layer."""
    return layers.groupBy("layer").agg(F.count("*").alias("entries"), F.sum(F.col("deleted").cast("bigint")).alias("tombstones"), F.sum(F.octet_length("key").cast("bigint")).alias("key_bytes"))
