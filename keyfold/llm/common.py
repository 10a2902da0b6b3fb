"""Shared plumbing of the training-data operators: inputs, the shared folder, written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the ASCII space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch handed to Python. Texts may be long, so batches are kept short.
ARROW_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's reader alone, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small enough for Python workers that share an executor's memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests) a temporary folder is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="keyfold-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it again.

    What comes back no longer depends on executors that may get lost.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._keyfold_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that no later step reads."""
    for df in tables:
        path = getattr(df, "_keyfold_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as no column has, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def shuffle_width(df: DataFrame, bytes_each: int = 1 << 27) -> int:
    """Partitions for a shuffle by hand of about as much as df: the session's number, or more where that would leave
    over bytes_each to a partition, by Spark's own estimate of df's size (over 10 PB: it has none)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if size > 10**16 else max(n, -(-size // bytes_each))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names, whatever else df holds: only(df, doc_id="bigint", text="string")."""
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind in columns.items()])
