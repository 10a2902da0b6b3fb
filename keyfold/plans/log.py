"""The ordered command log: commands from text, idempotent requests, batches, and replay per type.

Replay is declarative wherever the order of operations can be said as "newer than": the last reset of a
key (remove, set, or the first creating write after its deadline has passed) starts an epoch, and of a member or
field the last operation within the epoch counts. Lists are running sums: how many values a pop really takes follows
from the sizes, and those from the running minimum of pushes less pops. Only of keys that ever get a deadline
the operations that make, end or date a key are read one after another, since whether an expire has an effect
depends on the deadline before it; such a key's state is a few numbers, and its operations stream by.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.schema import ALIASES, COMMANDS


def parse(commands: DataFrame) -> DataFrame:
    """commands (..., command) with op, kind, key, args and error: words between spaces, no quoting; any case.

    An unknown command is an error of its own row and hurts no other one.
    """
    words = F.filter(F.split("command", " "), lambda w: w != "")
    named = F.lower(F.get("_w", F.lit(0)))
    names = F.create_map(*[F.lit(x) for pair in ({**{n: n for n in COMMANDS}, **ALIASES}).items() for x in pair])
    kinds = F.create_map(*[F.lit(x) for c in COMMANDS.values() for x in (c.name, c.kind)])
    out = commands.withColumn("_w", words).withColumn("op", F.try_element_at(names, named))
    return out.select(
        *commands.columns, "op", F.try_element_at(kinds, F.col("op")).alias("kind"), F.get("_w", F.lit(1)).alias("key"),
        F.when(F.size("_w") > 2, F.slice("_w", 3, F.greatest(F.size("_w") - 2, F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("args"),
        F.when(F.col("op").isNull(), F.concat(F.lit("unknown operation type: "), F.coalesce(F.get("_w", F.lit(0)), F.lit("")))).alias("error"),
    )


def deduplicated(log: DataFrame) -> DataFrame:
    """The log without repeats of a request id: the first by seq stays. Null ids are all kept."""
    first = log.where(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.min_by(F.struct(*[c for c in log.columns if c != "request_id"]), "seq").alias("_v"))
    return first.select("request_id", "_v.*").select(log.columns).unionByName(log.where(F.col("request_id").isNull()))


def runs(log: DataFrame, batch: str) -> DataFrame:
    """log (batch, seq, kind) as runs of one kind: (batch, run, kind, first_seq, last_seq, n). Reads of a run can
    go side by side, writes of a run are one append. No command is lost where the kind changes."""
    w = W.partitionBy(batch).orderBy("seq")
    turn = (F.col("kind") != F.lag("kind").over(w)).cast("int")
    numbered = log.withColumn("run", F.sum(F.coalesce(turn, F.lit(0))).over(w).cast("bigint"))
    return numbered.groupBy(batch, "run", "kind").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))


CREATES = {"sadd": "set", "zadd": "zset", "lpush": "list", "rpush": "list", "hset": "hash"}
STATE = "key string, reset bigint, by string, there boolean, expire_time bigint"


def _dated(log: DataFrame) -> DataFrame:
    """STATE of the keys that get a deadline somewhere in the log. An expire of a missing or expired key does nothing;
    a creating write to an expired key resets it and takes the deadline away."""
    seconds = F.when(F.col("op") == "set", F.get("args", F.lit(1))).otherwise(F.get("args", F.lit(0))).try_cast("bigint")
    ops = log.where(F.col("op").isin("set", "remove", "expire", *CREATES) & F.col("key").isNotNull())
    ops = ops.select("key", "seq", F.unix_seconds("ts").alias("t"), "op", F.when(F.col("op").isin("set", "expire"), F.coalesce(seconds, F.lit(0).cast("bigint"))).otherwise(0).alias("ttl"))
    keys = ops.where((F.col("op") == "expire") | (F.col("ttl") > 0)).select("key").distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, (None, None, False, 0), []
        for batch in batches:
            for k, seq, t, op, ttl in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if key is not None:
                        done.append((key, *state))
                    key, state = k, (None, None, False, 0)
                reset, by, there, deadline = state
                gone = t is not None and 0 < deadline < t
                until = t + ttl if ttl > 0 and t is not None else 0
                if op == "set":
                    state = (seq, op, True, until)
                elif op == "remove":
                    state = (seq, op, False, 0)
                elif op != "expire":
                    state = (seq - 1, "expired", True, 0) if gone else (reset, by, True, deadline)
                elif there and not gone:
                    state = (reset, by, there, until)
            if len(done) >= 10_000:
                yield rows(done)
                done = []
        if key is not None:
            done.append((key, *state))
        yield rows(done)

    def rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = {"key": pa.string(), "reset": pa.int64(), "by": pa.string(), "there": pa.bool_(), "expire_time": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))

    some = ops.join(keys, "key", "left_semi").select("key", "seq", "t", "op", "ttl")
    return some.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, STATE)


def resets(log: DataFrame) -> DataFrame:
    """(key, reset, by, expire_time): operations with seq > reset are the key's last epoch; by is what began it (set,
    remove, expired), both null if nothing did. Keys without any of these have no row.

    The last reset is a grouped maximum; a key's operations are never gathered. A log without ts or args has no deadlines;
    whether another one has any is looked up first.
    """
    last = log.where(F.col("op").isin("remove", "set")).groupBy("key").agg(F.max("seq").alias("reset"), F.max_by("op", "seq").alias("by"))
    last = last.select("key", F.col("reset").cast("bigint").alias("reset"), "by", F.lit(0).cast("bigint").alias("expire_time"))
    ttl = F.get("args", F.lit(1)).try_cast("bigint")
    if not {"ts", "args"} <= set(log.columns) or log.where((F.col("op") == "expire") | ((F.col("op") == "set") & (ttl > 0))).isEmpty():
        return last
    dated = _dated(log).select("key", "reset", "by", "expire_time")
    both = last.withColumn("dated", F.lit(False)).unionByName(dated.withColumn("dated", F.lit(True)))
    return both.groupBy("key").agg(F.max_by(F.struct("reset", "by", "expire_time"), "dated").alias("v")).select("key", "v.*")


def epochs(log: DataFrame) -> DataFrame:
    """log cut down to operations newer than the last reset of their key, removes and sets left out."""
    last = resets(log).select("key", F.col("reset").alias("_reset"))
    return log.join(last, "key", "left").where(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset"))).drop("_reset")


def members(log: DataFrame, add: str, drop: str) -> DataFrame:
    """(key, member) of sets after a log of adds and drops (args: members): the last operation of each decides."""
    ops = epochs(log).where(F.col("op").isin(add, drop)).select("key", "seq", "op", F.explode("args").alias("member"))
    return ops.groupBy("key", "member").agg(F.max_by("op", "seq").alias("op")).where(F.col("op") == add).select("key", "member")


def fields(log: DataFrame) -> DataFrame:
    """(key, field, value) of hashes after a log of hset (args: field, value, ...) and hdel (args: fields)."""
    live = epochs(log)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("args") - 2, F.lit(0)), F.lit(2)), lambda i: F.struct(F.get("args", i).alias("field"), F.get("args", i + 1).alias("value"), i.alias("i")))
    puts = live.where("op = 'hset'").select("key", "seq", F.explode(pairs).alias("p")).select("key", "seq", "p.i", "p.field", "p.value", F.lit(True).alias("there"))
    cuts = live.where("op = 'hdel'").select("key", "seq", F.lit(0).alias("i"), F.explode("args").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(False).alias("there"))
    last = F.max_by(F.struct("value", "there"), F.struct("seq", "i")).alias("v")
    return puts.unionByName(cuts).groupBy("key", "field").agg(last).where("v.there").select("key", "field", "v.value")


def scores(log: DataFrame) -> DataFrame:
    """(key, member, score, score_text) of sorted sets after a log of zadd (args: score, member, ...), zrem and
    zincr_by (args: increment, member): increments since the last zadd of a member are summed up."""
    live = epochs(log)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("args") - 2, F.lit(0)), F.lit(2)), lambda i: F.struct(F.get("args", i).alias("text"), F.get("args", i + 1).alias("member"), i.alias("i")))
    at = F.struct("seq", "i")
    sets = live.where("op = 'zadd'").select("key", "seq", F.explode(pairs).alias("p")).select("key", "seq", "p.*", F.lit(True).alias("there"))
    cuts = live.where("op = 'zrem'").select("key", "seq", F.lit(None).cast("string").alias("text"), F.explode("args").alias("member"), F.lit(0).alias("i"), F.lit(False).alias("there"))
    base = sets.unionByName(cuts).groupBy("key", "member").agg(F.max_by(F.struct("text", "there"), at).alias("v"), F.max("seq").alias("since")).where("v.there")
    more = live.where("op = 'zincr_by'").select("key", "seq", F.get("args", F.lit(0)).try_cast("decimal(28,8)").alias("by"), F.get("args", F.lit(1)).alias("member"))
    sums = more.join(base.select("key", "member", "since"), ["key", "member"]).where("seq > since").groupBy("key", "member").agg(F.sum("by").alias("by"))
    score = F.col("v.text").try_cast("double")
    moved = (score.cast("decimal(28,8)") + F.col("by")).cast("double")
    out = base.join(sums, ["key", "member"], "left")
    return out.select("key", "member", F.coalesce(moved, score).alias("score"), F.when(F.col("by").isNull(), F.col("v.text")).otherwise(F.format_string("%.6f", moved)).alias("score_text"))


def lists(log: DataFrame) -> DataFrame:
    """(key, pos, value) of lists after a log of pushes and pops (pop args: count, none for one).

    Values stand on a line: a push writes beyond an end, a pop moves an end. A list's size is the sum of pushes less
    pops, less what pops found nothing to take, which is the least that this sum has been below 0; so each pop's real count
    is known, and the ends are running sums of counts. What was written last on a place between the ends is there.
    """
    live = epochs(log).where(F.col("op").isin("lpush", "rpush", "lpop", "rpop", "lpop_n", "rpop_n"))
    push, left = F.col("op").like("%push"), F.col("op").startswith("l")
    asked = F.greatest(F.coalesce(F.get("args", F.lit(0)).try_cast("bigint"), F.lit(1)), F.lit(0))
    n = F.when(push, F.size("args")).otherwise(asked).cast("bigint")
    order = W.partitionBy("key").orderBy("seq")
    so_far = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    counts = live.select("key", "seq", push.alias("push"), left.alias("left"), n.alias("n"), F.when(push, F.col("args")).alias("args"))
    sums = counts.withColumn("sum", F.sum(F.when(F.col("push"), F.col("n")).otherwise(-F.col("n"))).over(so_far))
    sizes = sums.withColumn("size", F.col("sum") - F.least(F.min("sum").over(so_far), F.lit(0)))
    taken = F.coalesce(F.lag("size").over(order), F.lit(0)) - F.col("size")
    real = sizes.withColumn("moved", F.when(F.col("push"), F.col("n")).otherwise(-taken))
    ends = real.withColumn("first", -F.sum(F.when(F.col("left"), F.col("moved")).otherwise(0)).over(so_far)).withColumn("end", F.sum(F.when(F.col("left"), 0).otherwise(F.col("moved"))).over(so_far))
    last = ends.groupBy("key").agg(F.max_by(F.struct(F.col("first").alias("_first"), F.col("end").alias("_end")), "seq").alias("v")).select("key", "v.*")
    written = ends.where("push").select("key", "seq", "left", "first", "end", "n", F.posexplode("args").alias("i", "value"))
    place = F.when(F.col("left"), F.col("first") + F.col("n") - 1 - F.col("i")).otherwise(F.col("end") - F.col("n") + F.col("i"))
    there = written.withColumn("pos", place).join(last, "key").where((F.col("pos") >= F.col("_first")) & (F.col("pos") < F.col("_end")))
    return there.groupBy("key", "pos").agg(F.max_by("value", "seq").alias("value"))


def strings(log: DataFrame) -> DataFrame:
    """(key, value) of the keys whose last reset is a set (args: value, seconds to live)."""
    last = log.where(F.col("op") == "set").groupBy("key").agg(F.max("seq").alias("reset"), F.max_by(F.get("args", F.lit(0)), "seq").alias("value"))
    return last.join(resets(log).where("by = 'set'").select("key"), "key", "left_semi").select("key", "value")


def keyspace(log: DataFrame) -> DataFrame:
    """(key, vtype, expire_time) of the keys that are there after a log, expired ones included.

    The first creating write of an epoch decides on the type; the last expire with an effect, or the set itself, on the
    deadline.
    Emptied collections are still there.
    """
    kinds = F.create_map(*[F.lit(x) for pair in CREATES.items() for x in pair])
    made = epochs(log).where(F.col("op").isin(*CREATES)).groupBy("key").agg(F.min_by(F.try_element_at(kinds, F.col("op")), "seq").alias("vtype"))
    last = resets(log)
    typed = made.join(last.select("key", "by", "expire_time"), "key", "full")
    vtype = F.when(F.col("by") == "set", "string").otherwise(F.col("vtype"))
    return typed.select("key", vtype.alias("vtype"), F.coalesce("expire_time", F.lit(0).cast("bigint")).alias("expire_time")).where(F.col("vtype").isNotNull())
