"""Places of rows within keys of which one may hold much of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key with more rows than this is cut into parts of about so many, at most MOST parts.
PART, MOST = 100_000, 256


def numbered(df: DataFrame, key: str, order: list[str | Column], name: str) -> DataFrame:
    """df with name, each row's place from 0 within its key by order.

    A large key is cut into parts between rows of its own, chosen by a hash of the whole order, so equal first columns are cut
    by the later ones. A place is that within the part behind the sizes of the parts before; only parts are sorted,
    and only their sizes, pre-aggregated, meet by key. Rows that are equal in the whole order stay in one part.
    Whether there is a large key is looked up first, by a count of the keys; without one there is nothing to cut.
    """
    by = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"o{i}") for i, c in enumerate(order)])
    rows = df.withColumn("_by", by)
    large = rows.groupBy(key).agg(F.count("*").alias("_size")).where(F.col("_size") > PART).withColumnRenamed(key, "_key")
    if large.isEmpty():
        place = F.row_number().over(W.partitionBy(key).orderBy("_by")) - 1
        return rows.withColumn(name, place.cast("bigint")).drop("_by")
    one_in = F.ceil(F.col("_size") / F.least(F.lit(MOST), F.ceil(F.col("_size") / PART)))
    some = rows.select(F.col(key).alias("_key"), "_by").join(large, "_key").where(F.pmod(F.xxhash64("_by"), one_in) == 0)
    cuts = some.groupBy("_key").agg(F.array_sort(F.collect_set("_by")).alias("_cuts"))  # about MOST at most
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_by"))), F.lit(0))
    part = F.when(F.col("_cuts").isNull(), 0).otherwise(part)
    placed = rows.join(cuts, rows[key] == F.col("_key"), "left").withColumn("_part", part).drop("_cuts", "_key")
    before = W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.where(F.col("_part") >= 0).groupBy(key, "_part").agg(F.count("*").alias("_n"))
    ahead = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_part > 0").select(F.col(key).alias("_key"), F.col("_part").alias("_of"), "_before")
    place = F.row_number().over(W.partitionBy(key, "_part").orderBy("_by")) - 1
    whole = placed.withColumn("_at", place).join(ahead, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_of")), "left")
    return whole.withColumn(name, (F.coalesce("_before", F.lit(0)) + F.col("_at")).cast("bigint")).drop("_by", "_part", "_at", "_key", "_of", "_before")
