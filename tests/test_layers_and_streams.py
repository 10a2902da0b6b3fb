from __future__ import annotations

import random

import pytest

from keyfold.operators import keyspace as K
from keyfold.plans import layers as Y
from keyfold.sources.tables import write_sorted
from keyfold.streaming import apply as A

SCHEMA = "key string, value string, deleted boolean, expire_time bigint, ts timestamp, seq bigint"


def versions(spark, n=300, keys=20, seed=0):
    from datetime import UTC, datetime

    r = random.Random(seed)
    rows = [(f"k{r.randrange(keys):02}", f"v{i}", r.random() < 0.2, r.choice([0, 0, 100]), datetime.fromtimestamp(i // 3, UTC), i) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), rows


def live(rows, now=0):
    last = {}
    for r in rows:
        last[r[0]] = r
    return {(r[0], r[1]) for r in last.values() if not r[2] and (not now or r[3] == 0 or r[3] >= now)}


def pairs(df):
    return {(r.key, r.value) for r in df.collect()}


def test_merge_of_layers_is_the_whole_log(spark):
    df, rows = versions(spark)
    parts = Y.stacked([df.where(f"seq % 3 = {i}") for i in range(3)])
    assert pairs(Y.merge(parts)) == live(rows)
    assert pairs(Y.merge(parts, now=100)) == live(rows, 100) and pairs(Y.merge(parts, now=101)) == live(rows, 101)


def test_compactions_change_nothing_that_is_seen(spark):
    df, rows = versions(spark)
    layers = df.selectExpr("*", "cast(seq div 50 as int) as layer", "cast(seq < 50 as int) as level")
    once = Y.compact_size_tiered(layers, threshold=5)
    assert pairs(Y.merge(once.drop("layer", "level"))) == live(rows)
    assert once.where("level = 0").isEmpty() and once.where("deleted").count() > 0  # tombstones stay above an older layer
    assert Y.compact_size_tiered(layers, threshold=6).count() == layers.count()
    all_in_one = Y.compact_size_tiered(layers.selectExpr("key", "value", "deleted", "expire_time", "ts", "seq", "layer", "0 as level"), threshold=6)
    assert pairs(all_in_one) == live(rows) and all_in_one.where("deleted").isEmpty()
    leveled = Y.compact_leveled(layers, 0)
    assert pairs(Y.merge(leveled.drop("layer", "level"))) == live(rows)


def test_snapshots(spark, tmp_path):
    df, rows = versions(spark)
    write_sorted(Y.snapshot(df, 150), str(tmp_path / "snap"))
    snap = spark.read.parquet(str(tmp_path / "snap"))
    assert pairs(Y.snapshot_and_tail(snap, df, 150)) == live(rows)
    plan = K.key_range(snap, "k03", "k05")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,k03)" in plan and "LessThanOrEqual(key,k05)" in plan


@pytest.mark.parametrize("every", [2, 16])
def test_stream_of_batches_is_the_batch(spark, tmp_path, every):
    df, rows = versions(spark)
    source, state, mark = (str(tmp_path / n) for n in ("in", "state", "mark"))
    shuffled = list(range(6))
    random.Random(1).shuffle(shuffled)
    for i in shuffled:  # late batches lose against newer versions
        df.where(f"seq div 50 = {i}").coalesce(1).write.mode("append").parquet(source)
        q = A.keep_latest(spark.readStream.schema(SCHEMA).parquet(source), state, mark, every=every)
        q.awaitTermination()
    assert pairs(A.state(spark, state)) == live(rows)
    A.merge_batch(state, every)(df.limit(0), 98)
    assert len(A.layers(spark, state)) == (2 if every == 2 else 7)
    A.merge_batch(state, 3)(df.limit(0), 98)  # run again, now with a merge
    assert A.layers(spark, state) == [f"{state}/whole=98"]
    assert pairs(A.state(spark, state)) == live(rows)  # an empty batch, and one run again
    assert A.status(q)["writable"] is False


def test_stream_without_repeats(spark, tmp_path):
    log = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:00:01", "a"), (3, "2024-01-01 00:00:02", "b")], "seq int, t string, request_id string").selectExpr("seq", "cast(t as timestamp) as ts", "request_id")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = A.deduplicated(spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(r.request_id for r in spark.table("once").collect()) == ["a", "b"]


def test_expire(spark):
    state = spark.createDataFrame([("a", False, 0), ("b", True, 0), ("c", False, 50), ("d", False, 70)], "key string, deleted boolean, expire_time bigint")
    ask = spark.createDataFrame([("a", 10, 60), ("b", 10, 60), ("c", 10, 60), ("d", 0, 60), ("none", 1, 60)], "key string, ttl int, t long").selectExpr("key", "ttl", "timestamp_seconds(t) as ts")
    out, responses = K.expire(state, ask)
    assert {(r.key, r.expire_time) for r in out.collect()} == {("a", 70), ("b", 0), ("c", 50), ("d", 0)}
    assert {r.key: r.error for r in responses.collect()} == {"a": None, "b": None, "c": None, "d": None, "none": "key not found"}
