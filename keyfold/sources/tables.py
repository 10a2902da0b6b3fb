"""Sources: Parquet tables, op logs and element tables derived from them; sinks for logs and snapshots.

Files are written sorted by key with Parquet's bloom filter on it, so that lookups and key ranges skip row
groups; that is what an index is here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions.reduce import seconds
from keyfold.schema import OPLOG


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str, ttl: int = 0) -> DataFrame:
    """events as versions of `user:<id>`: (key, value, deleted, expire_time, ts, seq); an error is a tombstone."""
    e = table(spark, sf_dir, "events")
    deadline = seconds() + ttl if ttl else F.lit(0).cast("bigint")
    return e.select(
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.col("value"), "event_type", (F.col("event_type") == "error").alias("deleted"),
        deadline.alias("expire_time"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
    )


def order_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as strings `order:<10 digits>` -> total price."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("order:"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("key"), F.col("o_totalprice").alias("value"))


def supplier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as members to add: set `sup:<suppkey>`, member the part key."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.concat(F.lit("sup:"), F.col("l_suppkey").cast("string")).alias("key"), F.col("l_partkey").cast("string").alias("member"))


def customer_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as sorted sets `nation:<k>`: member c<custkey>, score the balance."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("key"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("member"), F.col("c_acctbal").alias("score"))


def customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as pushes to lists `cust:<custkey>`: (key, seq, value), seq in the order of date and order key."""
    o = table(spark, sf_dir, "orders")
    when = F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("n"))
    return o.select(F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), when.alias("seq"), F.col("o_orderkey").cast("string").alias("value"))


def nation_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier and nation rows as hashes: (key, field, value)."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    fields = lambda df, key, cols: df.select(key.alias("key"), F.explode(F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))])).alias("field", "value"))
    return fields(n, F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")), ["n_name", "n_regionkey"]).unionByName(fields(s, F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")), ["s_name", "s_nationkey"]))


def write_sorted(df: DataFrame, path: str, key: str = "key", mode: str = "error") -> None:
    """A sorted table: ranges of the key to tasks, sorted within, bloom filter on the key."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def append_log(log: DataFrame, path: str) -> None:
    """Appends to an op log, a folder for each day of ts."""
    log.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str, after: int | None = None, up_to: int | None = None) -> DataFrame:
    """The op log, or the part after / up to a sequence number."""
    log = spark.read.schema(OPLOG + ", day date").parquet(path).drop("day")
    if after is not None:
        log = log.where(F.col("seq") > after)
    return log if up_to is None else log.where(F.col("seq") <= up_to)
