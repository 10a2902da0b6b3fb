"""Structured Streaming over the op log: idempotent requests and newest-wins state.

State lives under one folder: each micro-batch adds its own newest versions as a layer, and every few batches
all layers are merged into a whole one, so a batch writes about as much as it brings. Layers are numbered by
batch id: a batch that is run again after a failure writes the same ones over again and nothing is applied twice.
Layers behind the whole one before the last are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keyfold.operators.keyspace import latest


def deduplicated(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A streaming log without repeats of a request id within the delay."""
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id"])


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """The numbers of the complete layers of a kind (part or whole), in order."""
    path, fs = _fs(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    found = [int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=")]
    return sorted(n for n in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}={n}/_SUCCESS")))


def layers(spark: SparkSession, folder: str, up_to: int | None = None, before: int | None = None) -> list[str]:
    """The layers that make the state: the newest whole one (before a number) and the parts behind it (up to a number)."""
    whole = [n for n in _complete(spark, folder, "whole") if before is None or n < before]
    since = whole[-1] if whole else -1
    parts = [n for n in _complete(spark, folder, "part") if n > since and (up_to is None or n <= up_to)]
    return [f"{folder}/whole={n}" for n in whole[-1:]] + [f"{folder}/part={n}" for n in parts]


def merge_batch(folder: str, every: int = 16):
    """The foreachBatch function that keeps the newest version of every key under folder, merging all of it after `every`
    batches."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest(batch).select(batch.columns).write.mode("overwrite").parquet(f"{folder}/part={number}")
        if (number + 1) % every:
            return
        rows = spark.read.schema(batch.schema).parquet(*layers(spark, folder, up_to=number, before=number))
        latest(rows).select(batch.columns).write.mode("overwrite").parquet(f"{folder}/whole={number}")
        for kind, names in {k: _complete(spark, folder, k) for k in ("part", "whole")}.items():
            last = ([-1] + [n for n in _complete(spark, folder, "whole") if n < number])[-1]  # readers may still have this one
            for n in names:
                if n < last or (kind == "part" and n == last):
                    path, fs = _fs(spark, f"{folder}/{kind}={n}")
                    fs.delete(path, True)

    return apply


def keep_latest(versions: DataFrame, folder: str, checkpoint: str, available_now: bool = True, every: int = 16) -> StreamingQuery:
    """Starts a query that keeps the newest versions of a stream (key, ..., ts, seq) under folder."""
    writer = versions.writeStream.foreachBatch(merge_batch(folder, every)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def state(spark: SparkSession, folder: str) -> DataFrame:
    """The live values of all layers."""
    paths = layers(spark, folder)
    if not paths:
        raise ValueError(f"no complete layer under {folder}")
    return latest(spark.read.parquet(*paths)).where(~F.col("deleted"))


def status(query: StreamingQuery) -> dict[str, object]:
    """What get_status answers: whether it runs, and how far it has come."""
    progress = query.lastProgress
    return {"writable": query.isActive, "batch": progress["batchId"] if progress else None, "rows": progress["numInputRows"] if progress else 0}
