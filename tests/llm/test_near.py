from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from keyfold.llm import kernels as K
from keyfold.llm import near
from keyfold.llm.components import components
from tests.compare import same
from tests.llm.conftest import odd_rows, prose


def sets(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w)} - {()} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, percent):
    """(doc_id, n_shingles, component_id, kept) of rows (doc_id, text)."""
    s = [(d, sets(t, size)) for d, t in rows]
    parent = {d: d for d, _ in s if d is not None}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    named = [(d, x) for d, x in s if d is not None and x]
    for i, (d, x) in enumerate(named):
        for e, y in named[:i]:
            if d != e and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((top(d), top(e)))
                parent[b] = a
    return sorted(((d, len(x), None if d is None else top(d), d is None or top(d) == d) for d, x in s), key=repr)


def found(df, **more):
    return sorted(map(tuple, near.near_duplicates(df, **more).collect()), key=repr)


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_odd_documents(clashing, size, percent):
    assert found(clashing, size=size, percent=percent) == brute([(r[0], r[1]) for r in odd_rows()], size, percent)


def test_empty_table(nothing):
    assert found(nothing) == []


@pytest.mark.parametrize("block,shingles,size,percent", [(1000, 1 << 20, 3, 85), (7, 1 << 20, 5, 80), (1000, 900, 3, 85)])
def test_edited_copies_of_one_text(spark, monkeypatch, block, shingles, size, percent):
    """Links through the original only, chains, and copies just below the threshold, in buckets of many documents; one
    tile, tiles of few documents, and tiles of few shingles."""
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "BLOCK_SHINGLES", shingles)
    r = random.Random(3)
    base = prose(11, 220).split()
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9, 14])):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w)))
    drift = list(base[:150])
    for i in range(30):
        drift[5 * i % 150] = f"drift{i}"
        rows.append((2000 + i, " ".join(drift)))
    rows += [(3000 + i, prose(500 + i, 90)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert found(df, size=size, percent=percent) == brute(rows, size, percent)


def test_fewest_matches_lose_only_what_they_may():
    for n, least in near.fewest(0.85, 120):
        below = np.random.default_rng(1).binomial(n, 0.85, 200_000) < least
        assert 0 < least < n and below.mean() < 1e-4


@pytest.mark.parametrize("percent", [20, 50, 70, 80, 85, 99, 100])
def test_bands_lose_only_what_they_may(percent):
    bands, rows = near.banding(percent)
    assert (1 - (percent / 100) ** rows) ** bands <= 1e-6
    assert {80: (35, 5), 85: (24, 5)}.get(percent, (bands, rows)) == (bands, rows)


def test_shingles_by_hand():
    buf, offs = K.text_buffer(pa.array(["a b c a b c", "A", None, "x y"]))
    g, d = near.shingles(buf, offs, 3)
    assert np.bincount(d, minlength=4).tolist() == [3, 1, 0, 1]


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_query(spark):
    same(near.op2_near_duplicates(spark, "/root/testdata/sf0.001"), near.ORACLE["op2_near_duplicates"], "/root/testdata/sf0.001")
