from __future__ import annotations

import pytest

from keyfold.config import Settings
from keyfold.schema import ERROR, SUCCESS
from keyfold.session import Session
from keyfold.sources.tables import read_log

TRACE = [
    ("set k_str v1", 1), ("get k_str", "v1"), ("exists k_str", 1), ("remove k_str", 1), ("get k_str", None), ("exists k_str", 0),
    ("sadd k_set m1 m2 m3", 3), ("smembers k_set", ["m1", "m2", "m3"]), ("sadd k_set m1 m9 m9", 1), ("srem k_set m1 m3 m9 none", 3), ("smembers k_set", ["m2"]), ("scard k_set", 1), ("sismember k_set m2", 1), ("remove k_set", 1), ("smembers k_set", []),
    ("zadd k_zset 10 one 20 two 30 three 40 four 50 five", 5), ("zscore k_zset one", "10"), ("zrank k_zset two", 1), ("zcard k_zset", 5), ("zincr_by k_zset 5 one", "15.000000"), ("zincr_by k_zset 5 nobody", "Member not be found"),
    ("zrange_by_rank k_zset 0 -1", [("15.000000", "one"), ("20", "two"), ("30", "three"), ("40", "four"), ("50", "five")]),
    ("ZRANGEBYSCORE k_zset 15 45", [("15.000000", "one"), ("20", "two"), ("30", "three"), ("40", "four")]), ("zrange_by_score k_zset 9 10", []),
    ("zrem k_zset three four", 2), ("zrem_by_rank k_zset 0 0", 1), ("zrem_by_score k_zset 40 40", 0), ("zrange k_zset 0 -1", [("20", "two"), ("50", "five")]),
    ("lpush k_list v1 v2 v3 v4 v5", 5), ("rpush k_list v6 v7", 7), ("lrange k_list 0 -1", ["v5", "v4", "v3", "v2", "v1", "v6", "v7"]), ("lget k_list 0", "v5"), ("lget k_list -1", "v7"), ("llen k_list", 7),
    ("lpop k_list", "v5"), ("rpop k_list", "v7"), ("lpopp_n k_list 2", ["v4", "v3"]), ("rpop_n k_list 1", ["v6"]), ("lrange k_list 0 -1", ["v2", "v1"]), ("lpop k_list 9", ["v2", "v1"]), ("lsize k_list", 0), ("exists k_list", 1), ("rpush k_list w", 1),
    ("hset k_hash f1 val1 f2 val2 f3 val3", 3), ("hget k_hash f1", "val1"), ("hset k_hash f1 new f9 x f9 y", 1), ("hkeys k_hash", ["f1", "f2", "f3", "f9"]), ("hvals k_hash", ["new", "val2", "val3", "y"]), ("hdel k_hash f1 f2 f9 none", 3), ("hgetall k_hash", [("f3", "val3")]),
    ("keys", ["k_hash", "k_list", "k_zset"]), ("keys k_.*t", ["k_list", "k_zset"]), ("range k_hash k_list", [("k_hash", {"f3": "val3"}), ("k_list", ["w"])]), ("remove k_hash none", 2), ("keys", ["k_list", "k_zset"]),
]


def test_golden_trace(spark):
    s = Session(spark)
    for text, want in TRACE:
        r = s.execute(text)
        assert (r.code, r.data) == (SUCCESS, want), (text, r)


@pytest.mark.parametrize(
    "before,text,error",
    [
        ("set a v", "sadd a m", "value is not a set"), ("sadd a m", "zadd a 1 m", "value is not a zset"), ("", "frob x", "unknown operation type: frob"), ("", "", "unknown operation type: "), ("", "get", "missing key"),
        ("", "set a", "missing arguments"), ("", "set", "missing arguments"), ("", "get a b", "too many arguments"), ("", "zadd a 1 m 2", "wrong number of arguments for 'zadd' command"), ("", "zadd a", "wrong number of arguments for 'zadd' command"), ("", "hset a f", "wrong number of arguments for 'hset' command"), ("", "hset a", "wrong number of arguments for 'hset' command"),
        ("", "remove", "missing key"), ("", "keys a b", "too many arguments"), ("", "exists a b", "too many arguments"), ("", "range a", "missing key"), ("", "range a b c", "too many arguments"), ("", "expire a", "missing key"), ("", "expire a 1 2", "too many arguments"), ("", "sadd s", "missing member"), ("", "srem s", "missing member"), ("", "sismember s", "missing member"), ("", "zrem z", "missing member"), ("", "zscore z", "missing member"), ("", "zrank z", "missing member"),
        ("", "zincr_by z 1", "missing increment or member"), ("", "zrange_by_rank z 1", "missing start or end"), ("", "zrem_by_rank z", "missing start or end"), ("", "zrange_by_score z 1", "missing min or max"), ("", "zrem_by_score z", "missing min or max"), ("", "lpush l", "missing value"), ("", "rpush l", "missing value"), ("", "lrange l 0", "missing start/end"), ("", "lget l", "missing index"), ("", "lpop_n l", "missing count"), ("", "rpop_n l", "missing count"), ("", "hget h", "missing field"), ("", "hdel h", "missing field"), ("", "hget h f", "not found"), ("", "lget l 3", "not found"), ("", "zrank z m", "not found"), ("", "rpop l", "empty"), ("", "zscore a m", "not found"),
        ("", "lpop a", "empty"), ("", "expire a 5", "key not found"), ("", "zincr_by a 1 m", "key not be found"), ("", "zadd a x m", "could not convert string to float: 'x'"), ("", "get_master", "not offered here: Spark runs the cluster"),
    ],
)
def test_errors(spark, before, text, error):
    s = Session(spark)
    if before:
        s.execute(before)
    r = s.execute(text)
    assert (r.code, r.error) == (ERROR, error)


def test_deadlines(spark):
    clock = [1000.0]
    s = Session(spark, now=lambda: clock[0])
    s.execute("set a v 10")
    s.execute("sadd b m")
    s.execute("expire b 5")
    clock[0] = 1005
    assert s.execute("smembers b").data == ["m"]  # still there in the second of its deadline
    clock[0] = 1006
    assert s.execute("exists b").data == 0 and s.execute("get a").data == "v"
    assert s.execute("sadd b n").data == 1 and s.execute("smembers b").data == ["n"]  # afresh, and without a deadline
    clock[0] = 1011
    assert s.execute("get a").data is None and s.execute("exists b").data == 1
    assert s.execute("expire b 1").data == 1 and s.execute("expire b 0").data == 1
    clock[0] = 5000
    assert s.execute("keys").data == ["b"]


def test_requests_are_answered_once_and_batches_lose_nothing(spark):
    s = Session(spark)
    assert s.execute("rpush l a", "r1") == s.execute("rpush l a", "r1")
    out = s.execute_batch([("1", "rpush l b"), ("2", "lsize l"), ("3", "frob"), ("4", "rpush l c"), ("1", "rpush l b"), (None, "lrange l 0 -1")])
    assert [r.code for r in out] == [1, 1, 0, 1, 1, 1] and out[-1].data == ["a", "b", "c"]
    before = s.execute("lsize l", "r2").data
    s.execute("rpush l d", "r3")
    assert s.execute("lsize l", "r2").data == before + 1  # a read is no stored answer
    assert Session(spark, read_only=True).execute("set a b").error == "read only"


def test_own_commands_and_logs(spark, tmp_path):
    s = Session(spark)
    s.register("double", lambda session, args: session.execute(f"rpush {args[0]} {args[1]} {args[1]}").data)
    assert s.execute("DOUBLE l x").data == 2
    s.execute("set k v")
    s.execute("rpush l z", "r7")
    s.flush(str(tmp_path / "log"))
    s.flush(str(tmp_path / "log"))
    log = read_log(spark, str(tmp_path / "log"))
    assert log.count() == 3 == log.select("seq").distinct().count() and log.where("request_id = 'r7'").count() == 1 and s.execute("lsize l").data == 3
    again = Session(spark, read_log(spark, str(tmp_path / "log")))
    assert again.execute("get k").data == "v" and again.execute("rpush l y").data == 4 and again.seq == 4


def test_a_session_with_a_path_holds_few_rows(spark, tmp_path):
    s = Session(spark, settings=Settings(held_rows=2, remembered_requests=1), path=str(tmp_path / "log"))
    for i in range(5):
        s.execute(f"set k{i} v", f"r{i}")
    assert len(s.rows) == 1 and read_log(spark, str(tmp_path / "log")).count() == 4 and list(s.answers) == ["r4"]
    assert s.execute("keys").data == [f"k{i}" for i in range(5)]
    assert Session(spark, settings=Settings(read_only=True)).execute("set a b").error == "read only"
