"""Snapshots of a state on disk: versions by sequence number, each with a manifest, and the log cut behind them.

A version is a sorted table and, written after it, a manifest of one row; a version without a manifest is
an export that didn't finish and isn't seen. Nothing is changed once written.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyfold.sources.tables import write_sorted

MANIFEST = "seq bigint, entries bigint, tombstones bigint, min_key string, max_key string, schema string"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def export(state: DataFrame, folder: str, seq: int) -> None:
    """Writes state (key, ..., deleted) as the version of seq; a version that is there already is an error."""
    spark = state.sparkSession
    if _there(spark, f"{folder}/manifest/seq={seq}"):
        raise ValueError(f"there is a snapshot of {seq} already")
    _delete(spark, f"{folder}/data/seq={seq}")  # of an export that didn't finish
    write_sorted(state, f"{folder}/data/seq={seq}")
    data = spark.read.schema(state.schema).parquet(f"{folder}/data/seq={seq}")
    facts = data.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.col("deleted").cast("bigint")), F.lit(0)).alias("tombstones"), F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.lit(state.schema.json()).alias("schema"))
    facts.coalesce(1).write.parquet(f"{folder}/manifest/seq={seq}")


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """MANIFEST of all finished versions."""
    if not _there(spark, f"{folder}/manifest/seq=*"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("basePath", f"{folder}/manifest").parquet(f"{folder}/manifest").select(*[c.split()[0] for c in MANIFEST.split(", ")])


def restore(spark: SparkSession, folder: str, up_to: int | None = None) -> tuple[DataFrame, int] | None:
    """(state, seq) of the newest version, or of the newest with seq <= up_to; None if there is none. What came behind it
    is the log after seq."""
    found = versions(spark, folder)
    if up_to is not None:
        found = found.where(F.col("seq") <= up_to)
    row = found.orderBy(F.desc("seq")).first()
    if row is None:
        return None
    return spark.read.schema(StructType.fromJson(json.loads(row["schema"]))).parquet(f"{folder}/data/seq={row.seq}"), row.seq


def delete(spark: SparkSession, folder: str, seq: int) -> None:
    """Deletes a version, its manifest first."""
    _delete(spark, f"{folder}/manifest/seq={seq}")
    _delete(spark, f"{folder}/data/seq={seq}")


def clear(spark: SparkSession, folder: str) -> None:
    _delete(spark, f"{folder}/manifest")
    _delete(spark, f"{folder}/data")


def truncate_log(spark: SparkSession, path: str, up_to: int) -> list[str]:
    """Deletes the days of an op log (see tables.append_log) that have no operation behind up_to, and says which.
    A day that has some stays whole: readers pass `after`."""
    log = spark.read.schema("seq bigint, day date").parquet(path)
    days = log.groupBy("day").agg(F.max("seq").alias("last")).where(F.col("last") <= up_to).orderBy("day").collect()
    names = [f"day={r.day}" if r.day is not None else "day=__HIVE_DEFAULT_PARTITION__" for r in days]
    for name in names:
        _delete(spark, f"{path}/{name}")
    return names
