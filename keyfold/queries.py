"""The library's queries over the test tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.functions import render as R
from keyfold.functions.reduce import seconds, six_places
from keyfold.operators import hashes as H
from keyfold.operators import keyspace as K
from keyfold.operators import lists as L
from keyfold.operators import sets as S
from keyfold.operators import zsets as Z
from keyfold.plans import layers as Y
from keyfold.plans import log as P
from keyfold.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, tuple[Query, str]] = {}

#: 2024-01-30 22:00:00 UTC
NOW = 1706652000
EVENTS = "(SELECT *, 'user:' || user_id AS key, event_type = 'error' AS deleted, event_id AS seq FROM events)"
LAST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM {EVENTS}) WHERE rn = 1)"
ORDERS = "(SELECT 'order:' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS key, o_totalprice AS value FROM orders)"
SUP = "(SELECT DISTINCT 'sup:' || l_suppkey AS key, CAST(l_partkey AS VARCHAR) AS member FROM lineitem)"
SMALL = "(SELECT CAST(p_partkey AS VARCHAR) AS member FROM part WHERE p_size < 10)"
SCORES = "(SELECT 'nation:' || c_nationkey AS key, 'c' || c_custkey AS member, c_acctbal AS score FROM customer)"
RANKED = f"(SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, count(*) OVER (PARTITION BY key) AS card FROM {SCORES})"
LISTS = "(SELECT 'cust:' || o_custkey AS key, CAST(o_orderkey AS VARCHAR) AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"
FIELDS = "(SELECT 'nation:' || n_nationkey AS key, unnest(['n_name', 'n_regionkey']) AS field, unnest([n_name, CAST(n_regionkey AS VARCHAR)]) AS value FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, unnest(['s_name', 's_nationkey']), unnest([s_name, CAST(s_nationkey AS VARCHAR)]) FROM supplier)"


def query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        FOUND[f.__name__] = (f, sql)
        return f

    return keep


def _plain(log: DataFrame) -> DataFrame:
    return log.select("key", "value", "deleted", "expire_time", "ts", "seq")


@query(f"SELECT key, value, seq FROM {LAST} WHERE NOT deleted")
def get_latest(spark: SparkSession, d: str) -> DataFrame:
    return K.get(_plain(T.events_log(spark, d))).select("key", "value", "seq")


@query(f"SELECT key, value, seq FROM {LAST} WHERE NOT deleted AND CAST(floor(epoch(ts)) AS BIGINT) + 86400 >= {NOW}")
def get_ttl_visible(spark: SparkSession, d: str) -> DataFrame:
    return K.get(_plain(T.events_log(spark, d, ttl=86400)), now=NOW).select("key", "value", "seq")


@query(f"SELECT key, value, seq FROM {LAST} WHERE NOT deleted AND key IN ('user:1', 'user:2', 'user:3', 'user:none')")
def get_keys(spark: SparkSession, d: str) -> DataFrame:
    wanted = spark.createDataFrame([(k,) for k in ("user:1", "user:2", "user:3", "user:none")], "key string")
    return K.get(_plain(T.events_log(spark, d)), keys=wanted).select("key", "value", "seq")


@query("SELECT 'cust:' || c_custkey AS key, CAST(EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS INTEGER) AS found FROM customer")
def exists_probe(spark: SparkSession, d: str) -> DataFrame:
    probes = T.table(spark, d, "customer").select(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("key"))
    return K.exists(T.customer_orders(spark, d), probes)


@query("SELECT DISTINCT 'order:' || o_orderkey AS key FROM orders WHERE regexp_full_match('order:' || o_orderkey, 'order:1[0-9]*')")
def keys_regex(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("key"))
    return K.keys(o, "order:1[0-9]*")


@query(f"SELECT key, value FROM {ORDERS} WHERE key BETWEEN 'order:0000000100' AND 'order:0000002000'")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    return K.key_range(T.order_strings(spark, d), "order:0000000100", "order:0000002000")


@query(f"SELECT key, value FROM {ORDERS} WHERE key NOT IN (SELECT 'order:' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') FROM orders WHERE o_custkey % 5 = 0)")
def remove_keys(spark: SparkSession, d: str) -> DataFrame:
    gone = T.table(spark, d, "orders").where("o_custkey % 5 = 0").select(F.concat(F.lit("order:"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("key"))
    return K.remove(T.order_strings(spark, d), gone)


@query("SELECT count(*) AS removed FROM orders WHERE o_custkey % 5 = 0")
def remove_count(spark: SparkSession, d: str) -> DataFrame:
    return K.removed(T.table(spark, d, "orders").where("o_custkey % 5 = 0"))


@query(f"SELECT key, deleted, CASE WHEN ask AND NOT deleted THEN CAST({NOW} + 60 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS expire_time FROM (SELECT *, user_id % 2 = 0 AS ask FROM {LAST})")
def expire_keys(spark: SparkSession, d: str) -> DataFrame:
    state = K.latest(_plain(T.events_log(spark, d)))
    ask = T.table(spark, d, "events").where("user_id % 2 = 0").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.lit(60).alias("ttl"), F.timestamp_seconds(F.lit(NOW)).alias("ts")).distinct()
    return K.expire(state, ask)[0].select("key", "deleted", "expire_time")


@query("SELECT key, value, expire_time FROM (SELECT 'user:' || user_id AS key, CAST(value AS VARCHAR) AS v, value, CASE WHEN user_id % 3 = 0 THEN CAST(floor(epoch(ts)) AS BIGINT) + 3600 ELSE 0 END AS expire_time, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def set_with_ttl(spark: SparkSession, d: str) -> DataFrame:
    e = T.events_log(spark, d)
    ask = T.table(spark, d, "events").select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), "value", F.when(F.col("user_id") % 3 == 0, 3600).alias("ttl"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))
    none = _plain(e).limit(0).withColumn("value", F.col("value").cast("string"))
    return K.latest(K.set_values(none, ask)).select("key", F.col("value").cast("double").alias("value"), "expire_time")


@query(f"SELECT key, count(*) AS added FROM {SUP} GROUP BY key")
def sadd_added(spark: SparkSession, d: str) -> DataFrame:
    return S.added(T.supplier_parts(spark, d))


@query(f"SELECT key, count(*) AS added FROM {SUP} WHERE member NOT IN {SMALL} GROUP BY key")
def sadd_added_over(spark: SparkSession, d: str) -> DataFrame:
    adds = T.supplier_parts(spark, d)
    small = T.table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").cast("string").alias("member"))
    return S.added(adds, adds.join(small, "member", "left_semi"))


@query(f"SELECT key, count(*) AS card FROM {SUP} GROUP BY key")
def scard(spark: SparkSession, d: str) -> DataFrame:
    return S.scard(T.supplier_parts(spark, d))


@query(f"SELECT key, member FROM {SUP}")
def smembers(spark: SparkSession, d: str) -> DataFrame:
    return S.smembers(T.supplier_parts(spark, d))


def _small_members(spark: SparkSession, d: str) -> DataFrame:
    small = T.table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").cast("string").alias("member"))
    return T.supplier_parts(spark, d).join(small, "member", "left_semi").select("key", "member")


@query(f"SELECT key, member FROM {SUP} WHERE member NOT IN {SMALL}")
def srem_members(spark: SparkSession, d: str) -> DataFrame:
    return S.srem(S.smembers(T.supplier_parts(spark, d)), _small_members(spark, d))


@query(f"SELECT key, count(*) AS removed FROM {SUP} WHERE member IN {SMALL} GROUP BY key")
def srem_count(spark: SparkSession, d: str) -> DataFrame:
    return S.srem_count(T.supplier_parts(spark, d), _small_members(spark, d))


@query(f"SELECT p.key, p.member, CAST(s.member IS NOT NULL AS INTEGER) AS found FROM (SELECT DISTINCT 'sup:' || l_suppkey AS key, CAST(l_partkey + 1 AS VARCHAR) AS member FROM lineitem) p LEFT JOIN {SUP} s ON s.key = p.key AND s.member = p.member")
def sismember(spark: SparkSession, d: str) -> DataFrame:
    line = T.table(spark, d, "lineitem")
    probes = line.select(F.concat(F.lit("sup:"), F.col("l_suppkey").cast("string")).alias("key"), (F.col("l_partkey") + 1).cast("string").alias("member")).distinct()
    return S.sismember(T.supplier_parts(spark, d), probes)


@query(f"SELECT p.key, p.member, CAST(s.member IS NOT NULL AS INTEGER) AS found FROM (SELECT 'sup:' || l_suppkey AS key, CAST(l_partkey AS VARCHAR) AS member FROM lineitem UNION SELECT 'sup:' || l_suppkey, CAST(l_partkey + 1 AS VARCHAR) FROM lineitem UNION SELECT 'sup:' || s_suppkey, CAST(s_suppkey AS VARCHAR) FROM supplier) p LEFT JOIN {SUP} s ON s.key = p.key AND s.member = p.member")
def sismember_every_key(spark: SparkSession, d: str) -> DataFrame:
    of = lambda df, key, member: df.select(F.concat(F.lit("sup:"), F.col(key).cast("string")).alias("key"), F.explode(member.cast("array<string>")).alias("member"))
    lines = of(T.table(spark, d, "lineitem"), "l_suppkey", F.array(F.col("l_partkey"), F.col("l_partkey") + 1))
    own = of(T.table(spark, d, "supplier"), "s_suppkey", F.array(F.col("s_suppkey")))
    return S.sismember(T.supplier_parts(spark, d), lines.unionByName(own).distinct())


@query("SELECT 'type:' || event_type AS key, 'u' || user_id AS member, value AS score FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def zadd_scores(spark: SparkSession, d: str) -> DataFrame:
    return Z.zadd(_event_scores(spark, d), ["ts", "seq"])


def _event_scores(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    return e.select(F.concat(F.lit("type:"), "event_type").alias("key"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("member"), F.col("value").alias("score"), "ts", F.col("event_id").alias("seq"))


TEXTS = "(SELECT 'type:' || event_type AS key, 'u' || user_id AS member, value AS score, CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS score_text FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"


def _score_texts(spark: SparkSession, d: str) -> DataFrame:
    return Z.zadd(_event_scores(spark, d).withColumn("score_text", F.col("score").cast("decimal(18,2)").cast("string")), ["ts", "seq"])


@query(f"SELECT key, member, score, score_text FROM {TEXTS}")
def zadd_score_texts(spark: SparkSession, d: str) -> DataFrame:
    return _score_texts(spark, d)


@query(f"SELECT 'type:' || e.event_type AS key, e.member, s.score, s.score_text FROM (SELECT DISTINCT event_type, 'u' || (user_id + 1) AS member FROM events) e LEFT JOIN {TEXTS} s ON s.key = 'type:' || e.event_type AND s.member = e.member")
def zscore_as_written(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    probes = e.select(F.concat(F.lit("type:"), "event_type").alias("key"), F.concat(F.lit("u"), (F.col("user_id") + 1).cast("string")).alias("member")).distinct()
    return Z.zscore(_score_texts(spark, d), probes)


@query("SELECT 'type:' || event_type AS key, count(*) AS added FROM events GROUP BY event_type")
def zadd_count(spark: SparkSession, d: str) -> DataFrame:
    return Z.zadd_count(_event_scores(spark, d))


@query(f"SELECT key, member, score FROM {SCORES} WHERE NOT (key = 'nation:3' OR member LIKE '%7')")
def zrem(spark: SparkSession, d: str) -> DataFrame:
    z = T.customer_scores(spark, d)
    return Z.zrem(z, z.where("key = 'nation:3' or member like '%7'").select("key", "member"))


@query(f"SELECT key, p.member, score FROM (SELECT DISTINCT 'nation:' || c_nationkey AS key, 'c' || (c_custkey + 1) AS member FROM customer) p LEFT JOIN {SCORES} s USING (key, member)")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    probes = T.table(spark, d, "customer").select(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("key"), F.concat(F.lit("c"), (F.col("c_custkey") + 1).cast("string")).alias("member")).distinct()
    return Z.zscore(T.customer_scores(spark, d), probes)


@query(f"SELECT key, count(*) AS card FROM {SCORES} GROUP BY key")
def zcard(spark: SparkSession, d: str) -> DataFrame:
    return Z.zcard(T.customer_scores(spark, d))


@query(f"SELECT key, member, score, rank FROM {RANKED}")
def zrank(spark: SparkSession, d: str) -> DataFrame:
    return Z.ranked(T.customer_scores(spark, d))


@query(f"SELECT 'all' AS key, member, score, row_number() OVER (ORDER BY score, member) - 1 AS rank FROM {SCORES}")
def zrank_wide(spark: SparkSession, d: str) -> DataFrame:
    return Z.ranked(T.customer_scores(spark, d).withColumn("key", F.lit("all")))


@query(f"SELECT key, member, rank FROM {RANKED}")
def zrank_of_members(spark: SparkSession, d: str) -> DataFrame:
    z = T.customer_scores(spark, d)
    return Z.zrank(z, z)


@query(f"SELECT key, member, rank FROM {RANKED}")
def zrank_of_every_member(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer")
    ids = F.array(F.col("c_custkey"), F.col("c_custkey") + 1)  # each member, and mostly one of another key
    probes = c.select(F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("key"), F.explode(F.transform(ids, lambda i: F.concat(F.lit("c"), i.cast("string")))).alias("member"))
    return Z.zrank(T.customer_scores(spark, d), probes)


@query(f"SELECT key, member, score, rank FROM {RANKED} WHERE rank BETWEEN 0 AND 4")
def zrange_by_rank(spark: SparkSession, d: str) -> DataFrame:
    return Z.zrange_by_rank(T.customer_scores(spark, d), 0, 4)


@query(f"SELECT key, member, score, rank FROM {RANKED} WHERE rank BETWEEN card - 2 AND card - 1")
def zrange_by_rank_neg(spark: SparkSession, d: str) -> DataFrame:
    return Z.zrange_by_rank(T.customer_scores(spark, d), -2, -1)


@query(f"SELECT key, member, score, rank FROM {RANKED} WHERE rank BETWEEN 2 AND card - 3")
def zrange_by_rank_mixed(spark: SparkSession, d: str) -> DataFrame:
    return Z.zrange_by_rank(T.customer_scores(spark, d), 2, -3)


@query(f"SELECT key, member, score FROM {SCORES} WHERE score BETWEEN 9 AND 1000")
def zrange_by_score(spark: SparkSession, d: str) -> DataFrame:
    return Z.zrange_by_score(T.customer_scores(spark, d), 9, 1000)


@query(f"SELECT key, member, score FROM {SCORES} WHERE NOT score BETWEEN 0 AND 5000")
def zrem_by_score(spark: SparkSession, d: str) -> DataFrame:
    return Z.zrem_by_score(T.customer_scores(spark, d), 0, 5000)


@query(f"SELECT key, member, score FROM {RANKED} WHERE rank > 2")
def zrem_by_rank(spark: SparkSession, d: str) -> DataFrame:
    return Z.zrem_by_rank(T.customer_scores(spark, d), 0, 2)


@query("SELECT 'users' AS key, 'u' || user_id AS member, CAST(CAST(100 AS DECIMAL(28, 8)) + sum(CAST(value AS DECIMAL(28, 8))) AS DOUBLE) AS score, printf('%.6f', CAST(CAST(100 AS DECIMAL(28, 8)) + sum(CAST(value AS DECIMAL(28, 8))) AS DOUBLE)) AS score_text FROM events GROUP BY user_id")
def zincr_by(spark: SparkSession, d: str) -> DataFrame:
    ups = T.table(spark, d, "events").select(F.lit("users").alias("key"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("member"), F.col("value").alias("by"))
    return Z.zincr_by(ups.select("key", "member").distinct().withColumn("score", F.lit(100.0)), ups)


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return L.rpush(None, T.customer_orders(spark, d), ["seq"])


@query(f"SELECT key, i AS pos, value FROM {LISTS}")
def rpush_list(spark: SparkSession, d: str) -> DataFrame:
    return _lists(spark, d)


@query(f"SELECT key, n - 1 - i AS index, value FROM {LISTS}")
def lpush_list(spark: SparkSession, d: str) -> DataFrame:
    return L.lrange(L.lpush(None, T.customer_orders(spark, d), ["seq"]), 0, -1)


@query("SELECT 'cust:' || o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN NOT front THEN 1 ELSE 0 END, CASE WHEN front THEN -r ELSE r END) - 1 AS index, CAST(o_orderkey AS VARCHAR) AS value FROM (SELECT *, o_orderpriority LIKE '1%' AS front, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)")
def push_both_ends(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    of = lambda df: df.select(F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("key"), F.struct("o_orderdate", "o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("value"))
    back = L.rpush(None, of(o.where("o_orderpriority not like '1%'")), ["seq"])
    return L.lrange(L.lpush(back, of(o.where("o_orderpriority like '1%'")), ["seq"]), 0, -1)


@query(f"SELECT key, i AS index, value FROM {LISTS} WHERE i BETWEEN 1 AND n - 2")
def lrange(spark: SparkSession, d: str) -> DataFrame:
    return L.lrange(_lists(spark, d), 1, -2)


@query(f"SELECT key, value FROM {LISTS} WHERE i = 2")
def lget(spark: SparkSession, d: str) -> DataFrame:
    return L.lget(_lists(spark, d), 2)


@query(f"SELECT key, value FROM {LISTS} WHERE i = n - 1")
def lget_neg(spark: SparkSession, d: str) -> DataFrame:
    return L.lget(_lists(spark, d), -1)


@query(f"SELECT key, count(*) AS size FROM {LISTS} GROUP BY key")
def lsize(spark: SparkSession, d: str) -> DataFrame:
    return L.lsize(_lists(spark, d))


@query(f"SELECT key, i + 1 AS nth, value FROM {LISTS} WHERE i < 1")
def lpop(spark: SparkSession, d: str) -> DataFrame:
    return L.lpop(_lists(spark, d))


@query(f"SELECT key, n - i AS nth, value FROM {LISTS} WHERE n - i <= 1")
def rpop(spark: SparkSession, d: str) -> DataFrame:
    return L.rpop(_lists(spark, d))


@query(f"SELECT key, i + 1 AS nth, value FROM {LISTS} WHERE i < 3")
def lpop_n(spark: SparkSession, d: str) -> DataFrame:
    return L.lpop(_lists(spark, d), 3)


@query(f"SELECT key, n - i AS nth, value FROM {LISTS} WHERE n - i <= 3")
def rpop_n(spark: SparkSession, d: str) -> DataFrame:
    return L.rpop(_lists(spark, d), 3)


@query(f"SELECT key, i AS pos, value FROM {LISTS} WHERE i >= 2 AND n - i > 1")
def after_pops(spark: SparkSession, d: str) -> DataFrame:
    return L.after_rpop(L.after_lpop(_lists(spark, d), 2), 1)


def _event_fields(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    return e.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("field"), "value", "ts", F.col("event_id").alias("seq"))


@query("SELECT 'user:' || user_id AS key, event_type AS field, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def hset_last_win(spark: SparkSession, d: str) -> DataFrame:
    return H.hset(_event_fields(spark, d), ["ts", "seq"])


@query("SELECT 'user:' || user_id AS key, count(DISTINCT event_type) AS added FROM events GROUP BY user_id")
def hset_new_fields(spark: SparkSession, d: str) -> DataFrame:
    return H.new_fields(_event_fields(spark, d))


@query(f"SELECT p.key, p.field, f.value FROM (SELECT 'supplier:' || s_suppkey AS key, unnest(['s_name', 's_phone']) AS field FROM supplier) p LEFT JOIN {FIELDS} f ON f.key = p.key AND f.field = p.field")
def hget(spark: SparkSession, d: str) -> DataFrame:
    probes = T.table(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("key"), F.explode(F.array(F.lit("s_name"), F.lit("s_phone"))).alias("field"))
    return H.hget(T.nation_hash(spark, d), probes)


@query(f"SELECT key, field, value FROM {FIELDS} WHERE field <> 'n_regionkey'")
def hdel(spark: SparkSession, d: str) -> DataFrame:
    h = T.nation_hash(spark, d)
    return H.hdel(h, h.where("field = 'n_regionkey'").select("key", "field"))


@query(f"SELECT key, count(*) AS deleted FROM {FIELDS} WHERE field = 'n_regionkey' GROUP BY key")
def hdel_count(spark: SparkSession, d: str) -> DataFrame:
    h = T.nation_hash(spark, d)
    return H.hdel_count(h, h.where("field = 'n_regionkey'").select("key", "field"))


@query(f"SELECT key, field FROM {FIELDS}")
def hkeys(spark: SparkSession, d: str) -> DataFrame:
    return H.hkeys(T.nation_hash(spark, d))


@query(f"SELECT key, value FROM {FIELDS}")
def hvalues(spark: SparkSession, d: str) -> DataFrame:
    return H.hvalues(T.nation_hash(spark, d))


@query(f"SELECT key, field, value FROM {FIELDS}")
def hentries(spark: SparkSession, d: str) -> DataFrame:
    return H.hentries(T.nation_hash(spark, d))


@query(f"SELECT key, '[' || string_agg(value, ',' ORDER BY i) || ']' AS text FROM {LISTS} GROUP BY key")
def render_lists(spark: SparkSession, d: str) -> DataFrame:
    return R.lists(_lists(spark, d))


@query("SELECT 'segment:' || c_mktsegment AS key, '(' || string_agg(DISTINCT CAST(c_nationkey AS VARCHAR), ',' ORDER BY CAST(c_nationkey AS VARCHAR)) || ')' AS text FROM customer GROUP BY c_mktsegment")
def render_sets(spark: SparkSession, d: str) -> DataFrame:
    c = T.table(spark, d, "customer").select(F.concat(F.lit("segment:"), "c_mktsegment").alias("key"), F.col("c_nationkey").cast("string").alias("member"))
    return R.sets(S.smembers(c))


@query(f"SELECT key, '{{' || string_agg(field || ': ' || value, ', ' ORDER BY field) || '}}' AS text FROM {FIELDS} GROUP BY key")
def render_hashes(spark: SparkSession, d: str) -> DataFrame:
    return R.hashes(T.nation_hash(spark, d))


@query(f"SELECT key, 'zset(' || string_agg(member || '=' || printf('%.6f', score), ', ' ORDER BY score, member) || ')' AS text FROM {RANKED} WHERE rank < 3 GROUP BY key")
def render_zsets(spark: SparkSession, d: str) -> DataFrame:
    top = Z.zrange_by_rank(T.customer_scores(spark, d), 0, 2)
    return R.zsets(top.withColumn("score_text", six_places(F.col("score"))))


def _layers(spark: SparkSession, d: str) -> DataFrame:
    """The events as six layers of level 0 and one of level 1, by time."""
    log = _plain(T.events_log(spark, d))
    layer = F.pmod(F.floor(seconds() / 86400), F.lit(7)).cast("int")
    return log.withColumn("layer", layer).withColumn("level", (layer == 0).cast("int"))


@query(f"SELECT key, value, seq FROM {LAST} WHERE NOT deleted")
def layer_merge(spark: SparkSession, d: str) -> DataFrame:
    return Y.merge(_layers(spark, d).drop("layer", "level")).select("key", "value", "seq")


@query(f"SELECT key, value, seq FROM {LAST} WHERE NOT deleted AND key BETWEEN 'user:2' AND 'user:5'")
def layer_range(spark: SparkSession, d: str) -> DataFrame:
    return Y.range_read(_layers(spark, d).drop("layer", "level"), "user:2", "user:5").select("key", "value", "seq")


LAYERED = f"(SELECT *, CAST(CAST(floor(floor(epoch(ts)) / 86400) AS BIGINT) % 7 AS INTEGER) AS layer, CASE WHEN CAST(floor(floor(epoch(ts)) / 86400) AS BIGINT) % 7 = 0 THEN 1 ELSE 0 END AS level FROM {EVENTS})"


@query(f"SELECT key, value, seq, layer, level FROM {LAYERED} WHERE level = 1 UNION ALL SELECT key, value, seq, 6 AS layer, 1 AS level FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM {LAYERED} WHERE level = 0) WHERE rn = 1")
def compaction_size_tiered(spark: SparkSession, d: str) -> DataFrame:
    return Y.compact_size_tiered(_layers(spark, d), threshold=5).select("key", "value", "seq", "layer", "level")


@query(
    f"WITH f AS (SELECT layer, level, min(key) AS lo, max(key) AS hi FROM {LAYERED} GROUP BY layer, level), o AS (SELECT * FROM f WHERE level = 0 ORDER BY layer LIMIT 1), "
    f"c AS (SELECT layer FROM o UNION SELECT f.layer FROM f, o WHERE f.level = 1 AND f.lo <= o.hi AND o.lo <= f.hi), "
    f"s AS (SELECT * FROM {LAYERED} WHERE layer NOT IN (SELECT layer FROM c)), deep AS (SELECT coalesce(max(level), -1) AS d FROM s), "
    f"m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) AS rn FROM {LAYERED} WHERE layer IN (SELECT layer FROM c)) WHERE rn = 1) "
    "SELECT key, value, seq, layer, level FROM s UNION ALL SELECT key, value, seq, (SELECT layer FROM o) AS layer, 1 AS level FROM m, deep WHERE NOT deleted OR deep.d > 0"
)
def compaction_leveled(spark: SparkSession, d: str) -> DataFrame:
    return Y.compact_leveled(_layers(spark, d), 0).select("key", "value", "seq", "layer", "level")


@query(f"WITH f AS (SELECT layer, level, min(key) AS lo, max(key) AS hi FROM {LAYERED} GROUP BY layer, level) SELECT u.layer, v.layer AS other FROM f u JOIN f v ON v.level = u.level + 1 AND u.lo <= v.hi AND v.lo <= u.hi")
def compaction_leveled_overlap(spark: SparkSession, d: str) -> DataFrame:
    files = Y.extents(_layers(spark, d))
    return Y.overlapping(files, files)


@query(f"SELECT key, value, seq FROM {LAST} WHERE NOT deleted")
def snapshot_plus_tail(spark: SparkSession, d: str) -> DataFrame:
    log = _plain(T.events_log(spark, d))
    return Y.snapshot_and_tail(Y.snapshot(log, 700).select(log.columns), log, 700).select("key", "value", "seq")


@query(f"SELECT layer, count(*) AS entries, CAST(sum(CAST(deleted AS INTEGER)) AS BIGINT) AS tombstones, CAST(sum(strlen(key)) AS BIGINT) AS key_bytes FROM {LAYERED} GROUP BY layer")
def stats_by_layer(spark: SparkSession, d: str) -> DataFrame:
    return Y.stats(_layers(spark, d))


@query("SELECT CAST(event_id AS VARCHAR) AS request_id, event_id AS seq, event_type AS op FROM events")
def request_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select(F.col("event_id").cast("string").alias("request_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("op"))
    again = e.where("seq % 3 = 0").withColumn("seq", F.col("seq") + 1_000_000_000).withColumn("op", F.lit("again"))
    return P.deduplicated(e.unionByName(again))


@query(
    "WITH k AS (SELECT user_id, event_id AS seq, CASE WHEN event_type IN ('view', 'click') THEN 'read' ELSE 'write' END AS kind FROM events), t AS (SELECT *, lag(kind) OVER (PARTITION BY user_id ORDER BY seq) AS p FROM k), "
    "n AS (SELECT *, CAST(sum(CASE WHEN p <> kind THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS run FROM t) "
    "SELECT user_id, run, kind, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM n GROUP BY user_id, run, kind"
)
def batch_runs(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "read").otherwise("write")
    return P.runs(T.table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), kind.alias("kind")), "user_id")


@query("SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'zrange_by_rank' WHEN 'signup' THEN 'set' WHEN 'purchase' THEN 'remove' END AS op, CASE WHEN event_type IN ('view', 'click') THEN 'read' WHEN event_type IN ('signup', 'purchase') THEN 'write' END AS kind, 'user:' || user_id AS key, CASE WHEN event_type = 'error' THEN 'unknown operation type: FROB' END AS error FROM events")
def parse_commands(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    verb = F.create_map(*[F.lit(x) for x in ("view", "GET", "click", "ZRange", "signup", "set", "purchase", "DEL", "error", "FROB")])[F.col("event_type")]
    commands = e.select(F.col("event_id").alias("seq"), F.concat_ws(" ", verb, F.concat(F.lit("user:"), F.col("user_id").cast("string"))).alias("command"))
    return P.parse(commands).select("seq", "op", "kind", "key", "error")


def _set_log(spark: SparkSession, d: str) -> DataFrame:
    op = F.create_map(*[F.lit(x) for x in ("view", "sadd", "click", "sadd", "signup", "sadd", "purchase", "srem", "error", "remove")])[F.col("event_type")]
    e = T.table(spark, d, "events")
    member = F.concat(F.lit("m"), (F.col("event_id") % 7).cast("string"))
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("request_id"), op.alias("op"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), F.array(member).alias("args"))


@query(
    "WITH r AS (SELECT user_id, max(event_id) AS r FROM events WHERE event_type = 'error' GROUP BY user_id), "
    "l AS (SELECT e.user_id, event_id % 7 AS m, event_type, row_number() OVER (PARTITION BY e.user_id, event_id % 7 ORDER BY event_id DESC) AS rn FROM events e LEFT JOIN r ON r.user_id = e.user_id WHERE event_type <> 'error' AND event_id > coalesce(r, -1)) "
    "SELECT 'user:' || user_id AS key, 'm' || m AS member FROM l WHERE rn = 1 AND event_type <> 'purchase'"
)
def replay_sets(spark: SparkSession, d: str) -> DataFrame:
    return P.members(_set_log(spark, d), "sadd", "srem")


@query(
    "WITH r AS (SELECT user_id, max(event_id) AS r FROM events WHERE event_type = 'error' GROUP BY user_id), "
    "l AS (SELECT e.user_id, event_id % 7 AS m, value, row_number() OVER (PARTITION BY e.user_id, event_id % 7 ORDER BY event_id DESC) AS rn FROM events e LEFT JOIN r ON r.user_id = e.user_id WHERE event_type <> 'error' AND event_id > coalesce(r, -1)) "
    "SELECT 'user:' || user_id AS key, 'f' || m AS field, CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS value FROM l WHERE rn = 1"
)
def replay_hashes(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events")
    op = F.when(F.col("event_type") == "error", "remove").otherwise("hset")
    args = F.array(F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string")), F.col("value").cast("decimal(18,2)").cast("string"))
    return P.fields(e.select(F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), args.alias("args")))


def _event_log(spark: SparkSession, d: str, ops: dict[str, str], args) -> DataFrame:
    """events as a log on `user:<id>`: the operation of each kind of event, the arguments from args."""
    e = T.table(spark, d, "events")
    op = F.create_map(*[F.lit(x) for pair in ops.items() for x in pair])[F.col("event_type")]
    return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("request_id"), op.alias("op"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("key"), args.alias("args"))


RESET = "SELECT user_id, max(event_id) AS r FROM events WHERE event_type = 'error' GROUP BY user_id"


@query(
    f"WITH r AS ({RESET}), l AS (SELECT e.user_id, event_id % 7 AS m, event_type, value, row_number() OVER (PARTITION BY e.user_id, event_id % 7 ORDER BY event_id DESC) AS rn FROM events e LEFT JOIN r ON r.user_id = e.user_id WHERE event_type <> 'error' AND event_id > coalesce(r, -1)) "
    "SELECT 'user:' || user_id AS key, 'm' || m AS member, CAST(CAST(value AS DECIMAL(18, 2)) AS DOUBLE) AS score, CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) AS score_text FROM l WHERE rn = 1 AND event_type <> 'purchase'"
)
def replay_zsets(spark: SparkSession, d: str) -> DataFrame:
    member = F.concat(F.lit("m"), (F.col("event_id") % 7).cast("string"))
    args = F.when(F.col("event_type") == "purchase", F.array(member)).otherwise(F.array(F.col("value").cast("decimal(18,2)").cast("string"), member))
    return P.scores(_event_log(spark, d, {"view": "zadd", "click": "zadd", "signup": "zadd", "purchase": "zrem", "error": "remove"}, args))


@query(
    f"WITH r AS ({RESET}), l AS (SELECT e.user_id, event_id, event_type FROM events e LEFT JOIN r ON r.user_id = e.user_id WHERE event_type IN ('view', 'click', 'signup') AND event_id > coalesce(r, -1)), "
    "n AS (SELECT user_id, event_id, event_type = 'signup' AS front, row_number() OVER (PARTITION BY user_id, event_type = 'signup' ORDER BY event_id) AS n FROM l) "
    "SELECT 'user:' || user_id AS key, CASE WHEN front THEN -n ELSE n - 1 END AS pos, CAST(event_id AS VARCHAR) AS value FROM n"
)
def replay_lists(spark: SparkSession, d: str) -> DataFrame:
    args = F.array(F.col("event_id").cast("string"))
    return P.lists(_event_log(spark, d, {"view": "rpush", "click": "rpush", "signup": "lpush", "purchase": "lsize", "error": "remove"}, args))


@query(
    "WITH o AS (SELECT user_id, event_id, event_type IN ('view', 'click', 'signup') AS push, event_type = 'error' AS reset FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase', 'error')), "
    f"l AS (SELECT o.* FROM o LEFT JOIN ({RESET}) r ON r.user_id = o.user_id WHERE NOT reset AND event_id > coalesce(r, -1)), "
    "s AS (SELECT *, sum(CASE WHEN push THEN 1 ELSE -1 END) OVER w AS s FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), "
    "m AS (SELECT *, s - least(min(s) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS size FROM s), "
    "z AS (SELECT user_id, arg_max(size, event_id) AS size FROM m GROUP BY user_id), "
    "p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM l WHERE push) "
    "SELECT 'user:' || p.user_id AS key, CAST(p.event_id AS VARCHAR) AS value FROM p JOIN z ON z.user_id = p.user_id WHERE back <= size"
)
def replay_queues(spark: SparkSession, d: str) -> DataFrame:
    """Lists pushed at the back and popped from the front: what is left are the last ones pushed."""
    args = F.when(F.col("event_type") == "purchase", F.array().cast("array<string>")).otherwise(F.array(F.col("event_id").cast("string")))
    return P.lists(_event_log(spark, d, {"view": "rpush", "click": "rpush", "signup": "rpush", "purchase": "lpop", "error": "remove"}, args)).select("key", "value")


@query(f"SELECT key, value FROM (SELECT 'user:' || user_id AS key, CAST(event_id AS VARCHAR) AS value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type IN ('signup', 'error')) WHERE rn = 1 AND event_type = 'signup'")
def replay_strings(spark: SparkSession, d: str) -> DataFrame:
    args = F.array(F.col("event_id").cast("string"))
    return P.strings(_event_log(spark, d, {"view": "get", "click": "get", "signup": "set", "purchase": "get", "error": "remove"}, args))


@query(
    f"WITH r AS ({RESET}), l AS (SELECT e.user_id, event_id, event_type FROM events e LEFT JOIN r ON r.user_id = e.user_id WHERE event_type IN ('view', 'click', 'purchase') AND event_id > coalesce(r, -1)) "
    "SELECT 'user:' || user_id AS key, CASE arg_min(event_type, event_id) WHEN 'view' THEN 'set' WHEN 'click' THEN 'zset' ELSE 'hash' END AS vtype, CAST(0 AS BIGINT) AS expire_time FROM l GROUP BY user_id"
)
def replay_keyspace(spark: SparkSession, d: str) -> DataFrame:
    args = F.array(F.lit("1"), F.lit("m"))
    return P.keyspace(_event_log(spark, d, {"view": "sadd", "click": "zadd", "signup": "srem", "purchase": "hset", "error": "remove"}, args))


@query(
    "WITH RECURSIVE o AS (SELECT user_id, event_id, event_type AS op, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type <> 'purchase'), "
    "f AS (SELECT user_id, CAST(0 AS BIGINT) AS i, false AS there, CAST(0 AS BIGINT) AS deadline, CAST(-1 AS BIGINT) AS since FROM (SELECT DISTINCT user_id FROM o) "
    "UNION ALL SELECT o.user_id, o.i, CASE WHEN op = 'error' THEN false WHEN op = 'signup' THEN there ELSE true END, "
    "CASE WHEN op = 'error' THEN 0 WHEN op = 'signup' THEN CASE WHEN there AND NOT (deadline > 0 AND t > deadline) THEN t + 86400 ELSE deadline END WHEN deadline > 0 AND t > deadline THEN 0 ELSE deadline END, "
    "CASE WHEN op = 'error' THEN event_id WHEN op <> 'signup' AND deadline > 0 AND t > deadline THEN event_id - 1 ELSE since END FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1), "
    "z AS (SELECT user_id, arg_max(there, i) AS there, arg_max(deadline, i) AS deadline, arg_max(since, i) AS since FROM f GROUP BY user_id) "
    "SELECT DISTINCT 'user:' || e.user_id AS key, 'm' || (event_id % 7) AS member, deadline AS expire_time FROM events e JOIN z ON z.user_id = e.user_id WHERE there AND event_type IN ('view', 'click') AND event_id > since"
)
def replay_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Sets with deadlines a day ahead of each signup: what is written after one has passed starts afresh."""
    member = F.concat(F.lit("m"), (F.col("event_id") % 7).cast("string"))
    args = F.when(F.col("event_type") == "signup", F.array(F.lit("86400"))).otherwise(F.array(member))
    log = _event_log(spark, d, {"view": "sadd", "click": "sadd", "signup": "expire", "purchase": "smembers", "error": "remove"}, args)
    return P.members(log, "sadd", "srem").join(P.keyspace(log).select("key", "expire_time"), "key")


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items()}
