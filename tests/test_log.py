"""Replay of random logs against a plain sequential fold."""

from __future__ import annotations

import random
from datetime import UTC, datetime

import pytest

from keyfold.plans import log as P
from keyfold.schema import OPLOG


def frame(spark, ops):
    return spark.createDataFrame([(i, None, None, op, key, args) for i, (op, key, args) in enumerate(ops)], OPLOG)


def fold(ops, start, step):
    state = {}
    for op, key, args in ops:
        if op in ("remove", "set"):
            state.pop(key, None)
        else:
            step(state.setdefault(key, start()), op, args)
    return state


def some(seed, kinds, args):
    r = random.Random(seed)
    return [(op, f"k{r.randrange(6)}", args(r, op)) for op in (r.choices([k for k, _ in kinds], [w for _, w in kinds])[0] for _ in range(400))]


@pytest.mark.parametrize("seed", range(3))
def test_sets(spark, seed):
    ops = some(seed, [("sadd", 6), ("srem", 4), ("remove", 1)], lambda r, op: [] if op == "remove" else [f"m{r.randrange(8)}" for _ in range(r.randint(1, 3))])
    want = fold(ops, set, lambda s, op, a: s.update(a) if op == "sadd" else s.difference_update(a))
    got = {tuple(r) for r in P.members(frame(spark, ops), "sadd", "srem").collect()}
    assert got == {(k, m) for k, s in want.items() for m in s}


@pytest.mark.parametrize("seed", range(3))
def test_hashes(spark, seed):
    def args(r, op):
        if op == "remove":
            return []
        return [x for _ in range(r.randint(1, 3)) for x in ([f"f{r.randrange(6)}", str(r.randrange(99))] if op == "hset" else [f"f{r.randrange(6)}"])]

    def step(h, op, a):
        if op == "hset":
            h.update(zip(a[::2], a[1::2], strict=True))
        else:
            for f in a:
                h.pop(f, None)

    ops = some(seed, [("hset", 6), ("hdel", 3), ("remove", 1)], args)
    got = {tuple(r) for r in P.fields(frame(spark, ops)).collect()}
    assert got == {(k, f, v) for k, h in fold(ops, dict, step).items() for f, v in h.items()}


@pytest.mark.parametrize("seed", range(3))
def test_sorted_sets(spark, seed):
    def args(r, op):
        m = f"m{r.randrange(5)}"
        return {"remove": [], "zadd": [str(r.randrange(50)), m, str(r.randrange(50)), f"m{r.randrange(5)}"], "zrem": [m], "zincr_by": [str(r.randrange(-9, 9)), m]}[op]

    def step(z, op, a):
        if op == "zadd":
            z.update(zip(a[1::2], a[::2], strict=True))
        elif op == "zrem":
            z.pop(a[0], None)
        elif a[1] in z:
            z[a[1]] = f"{float(z[a[1]]) + float(a[0]):.6f}"

    ops = some(seed, [("zadd", 3), ("zrem", 2), ("zincr_by", 5), ("remove", 0.3)], args)
    got = {(r.key, r.member, r.score_text) for r in P.scores(frame(spark, ops)).collect()}
    assert got == {(k, m, t) for k, z in fold(ops, dict, step).items() for m, t in z.items()}


@pytest.mark.parametrize("seed", range(3))
def test_lists(spark, seed):
    def args(r, op):
        if op.endswith("push"):
            return [f"v{r.randrange(99)}" for _ in range(r.randint(1, 3))]
        return [str(r.randint(0, 4))] if op.endswith("_n") else []

    def step(x, op, a):
        if op == "rpush":
            x.extend(a)
        elif op == "lpush":
            x[:0] = a[::-1]
        else:
            n = int(a[0]) if a else 1
            if op[0] == "l":
                del x[:n]
            elif n:
                del x[-n:]

    ops = some(seed, [("rpush", 4), ("lpush", 4), ("lpop", 2), ("rpop", 2), ("lpop_n", 1), ("rpop_n", 1), ("remove", 0.5)], args)
    ops += [("rpush", "only", ["a", "b"]), ("lpush", "only", ["c", "d"]), ("rpush", "only", ["e"])]
    got = {}
    for r in P.lists(frame(spark, ops)).orderBy("key", "pos").collect():
        got.setdefault(r.key, []).append(r.value)
    assert got == {k: x for k, x in fold(ops, list, step).items() if x}


def with_deadlines(ops):
    """Plain state of (t, op, key, args): key -> [vtype, deadline, set of members]."""
    state = {}
    for t, op, key, args in ops:
        held = state.get(key)
        gone = held is not None and 0 < held[1] < t
        if op == "remove":
            state.pop(key, None)
        elif op == "set":
            state[key] = ["string", t + int(args[1]) if len(args) > 1 and int(args[1]) else 0, set()]
        elif op == "expire":
            if held is not None and not gone:
                held[1] = t + int(args[0]) if int(args[0]) else 0
        elif op == "sadd":
            if held is None or gone:
                held = state[key] = ["set", 0, set()]
            held[2].update(args)
        elif held is not None and not gone:
            held[2].difference_update(args)
    return state


@pytest.mark.parametrize("seed", range(4))
def test_deadlines(spark, seed):
    r = random.Random(seed)
    ops, t = [], 1000
    for _ in range(500):
        t += r.choice([0, 1, 1, 4])
        op = r.choices(["sadd", "srem", "expire", "set", "remove"], [6, 3, 4, 1, 1])[0]
        args = {"sadd": lambda: [f"m{r.randrange(9)}"], "srem": lambda: [f"m{r.randrange(9)}"], "expire": lambda: [str(r.choice([0, 3, 20, 60]))], "set": lambda: ["v", str(r.choice([0, 5, 40]))], "remove": list}[op]()
        ops.append((t, op, f"k{r.randrange(8)}", args))
    # a string isn't added to while it lives, here as in the session
    kept = []
    for o in ops:
        held = with_deadlines(kept).get(o[2])
        if o[1] not in ("sadd", "srem") or held is None or held[0] == "set" or 0 < held[1] < o[0]:
            kept.append(o)
    log = spark.createDataFrame([(i, datetime.fromtimestamp(t, UTC), None, op, key, args) for i, (t, op, key, args) in enumerate(kept)], OPLOG)
    want = with_deadlines(kept)
    assert {tuple(x) for x in P.keyspace(log).collect()} == {(k, v, e) for k, (v, e, _) in want.items()}
    sets = {}
    for x in P.members(log, "sadd", "srem").collect():
        sets.setdefault(x.key, set()).add(x.member)
    live = {k for k, (v, e, _) in want.items() if v == "set" and not 0 < e < t}
    assert {k: s for k, s in sets.items() if k in live} == {k: want[k][2] for k in live if want[k][2]}


def test_a_write_after_the_deadline_starts_afresh(spark):
    ops = [(0, "sadd", ["a"]), (0, "expire", ["5"]), (60, "sadd", ["b"])]
    log = spark.createDataFrame([(i, datetime.fromtimestamp(t, UTC), None, op, "k", args) for i, (t, op, args) in enumerate(ops)], OPLOG)
    assert [tuple(r) for r in P.members(log, "sadd", "srem").collect()] == [("k", "b")]
    assert [tuple(r) for r in P.keyspace(log).collect()] == [("k", "set", 0)]


def test_parse(spark):
    df = spark.createDataFrame([(1, "ZADD  k 1 a "), (2, "frob k"), (3, ""), (4, "LLEN l")], "seq int, command string")
    rows = {r.seq: r for r in P.parse(df).collect()}
    assert (rows[1].op, rows[1].kind, rows[1].key, rows[1].args, rows[1].error) == ("zadd", "write", "k", ["1", "a"], None)
    assert rows[2].op is None and rows[2].error == "unknown operation type: frob" and rows[3].error == "unknown operation type: "
    assert (rows[4].op, rows[4].args) == ("lsize", [])


def test_keyspace(spark):
    ops = [("set", "a", ["1"]), ("sadd", "b", ["m"]), ("srem", "b", ["m"]), ("remove", "a", []), ("zadd", "a", ["1", "m"]), ("srem", "c", ["m"]), ("set", "d", ["x"]), ("remove", "d", [])]
    assert {(r.key, r.vtype) for r in P.keyspace(frame(spark, ops)).collect()} == {("a", "zset"), ("b", "set")}


def test_null_request_ids_are_not_repeats(spark):
    df = spark.createDataFrame([(1, "r"), (2, "r"), (3, None), (4, None)], "seq int, request_id string")
    assert sorted(r.seq for r in P.deduplicated(df).collect()) == [1, 3, 4]
