from __future__ import annotations

import random

import pytest

from keyfold.operators import lists as L
from keyfold.operators import order
from keyfold.operators import zsets as Z


@pytest.mark.parametrize("part", [5, 100_000])
def test_ranks_of_one_key_with_equal_scores(spark, monkeypatch, part):
    """One key holds nearly all rows, most of them with one score: ranks are those of a sort, and parts stay small."""
    monkeypatch.setattr(order, "PART", part)
    r = random.Random(2)
    rows = [("big", f"m{i}", 7.0 if r.random() < 0.8 else r.random() * 20) for i in range(600)] + [("small", "a", 1.0), ("small", "b", 0.5)]
    z = spark.createDataFrame(rows, "key string, member string, score double").repartition(4)
    want = {(k, m): i for key in ("big", "small") for i, (_, m, k) in enumerate(sorted((s, m, k) for k, m, s in rows if k == key))}
    assert {(x.key, x.member): x["rank"] for x in Z.ranked(z).collect()} == want
    probes = spark.createDataFrame([("big", "m3"), ("big", "none"), ("small", "a"), ("none", "a")], "key string, member string")
    assert {(x.key, x.member): x["rank"] for x in Z.zrank(z, probes).collect()} == {k: want[k] for k in (("big", "m3"), ("small", "a"))}
    assert {(x.key, x.member) for x in Z.zrange_by_rank(z, 3, -2).collect()} == {k for k, i in want.items() if k[0] == "big" and 3 <= i <= 598}


@pytest.mark.parametrize("part", [7, 100_000])
def test_pushes_to_one_list(spark, monkeypatch, part):
    monkeypatch.setattr(order, "PART", part)
    pushes = spark.createDataFrame([("l", i * 7919 % 500, f"v{i * 7919 % 500}") for i in range(500)] + [("k", 1, "x")], "key string, seq int, value string").repartition(3)
    back = {(r.key, r.pos): r.value for r in L.rpush(None, pushes, ["seq"]).collect()}
    assert back == {**{("l", i): f"v{i}" for i in range(500)}, ("k", 0): "x"}
    front = {(r.key, r.pos): r.value for r in L.lpush(None, pushes, ["seq"]).collect()}
    assert front == {**{("l", -1 - i): f"v{i}" for i in range(500)}, ("k", -1): "x"}
