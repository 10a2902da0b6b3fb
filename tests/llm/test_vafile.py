from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyfold.llm import vafile
from tests.compare import same

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string"


def brute(rows, k=5, step=50):
    v = [(i, [math.floor(256 * x) for x in e]) for i, e, *_ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    queries = {}
    for i, e in v:
        if i % step == 0:
            queries[i] = min(queries.get(i, e), e)
    out = []
    for q, e in queries.items():
        found = sorted((-sum(a * b for a, b in zip(e, x, strict=True)), i) for i, x in v if i != q and len(x) == len(e) and len(e))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def ask(spark, rows):
    v = vafile.quantise(spark.createDataFrame(rows, SCHEMA))
    return sorted(tuple(r) for r in vafile.top_k(v, v.where("vec_id % 50 = 0")).collect())


def test_oddities(spark):
    r = random.Random(5)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)], 0, "") for i in range(300)]
    rows += [(i, [0.5] * 8, None, None) for i in range(400, 420)]  # ties
    rows += [(1000, None, 1, ""), (1001, [None] * 8, 1, ""), (1002, [float("nan")] * 8, 1, ""), (1050, [float("inf")] + [0.0] * 7, 1, ""), (None, [0.1] * 8, 1, "")]
    rows += [rows[3], rows[50], rows[50]]  # repeated rows
    rows += [(1100, [1.0, 2.0], 1, ""), (1101, [3.0, -1.0], 1, ""), (1150, [], 1, "")]
    assert ask(spark, rows) == brute(rows)


def test_few_and_none(spark):
    assert ask(spark, []) == []
    assert ask(spark, [(0, [1.0], 0, "")]) == []
    rows = [(0, [0.004], 0, ""), (1, [-0.004], 0, "")]
    assert ask(spark, rows) == brute(rows) == [(0, 1, 1, -2)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(-3000, 3000), min_size=3, max_size=3), min_size=2, max_size=60), st.integers(1, 6))
def test_bounds_rule_nothing_out_that_is_among_the_best(vectors, k):
    v, ids = np.array(vectors), np.arange(len(vectors))
    low, step, cells = vafile.cells_of(v)
    found = vafile.scan(v.astype(float), ids, ids, low, step, cells, k).possible(k)
    there = set(zip(found.q.tolist(), found.row.tolist(), strict=True))
    for i in range(len(v)):
        exact = v @ v[i]
        others = sorted((-exact[j], j) for j in range(len(v)) if j != i)
        assert {(i, j) for _, j in others[:k]} <= there
    exact = (v[found.q] * v[found.row]).sum(axis=1)
    assert ((found.lower <= exact) & (exact <= found.upper)).all()


def test_few_exact_vectors_are_read(spark):
    """Components of wide range, so that cells are coarse: results are exact, and few exact vectors are read for them."""
    r = random.Random(6)
    rows = [(i, [r.randint(-6400, 6400) / 64 for _ in range(16)], 0, "") for i in range(2000)]
    seen = []
    real = vafile.read

    def counted(wanted, *rest):
        seen.append(wanted.count())
        return real(wanted, *rest)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(vafile, "read", counted)
        m.setattr(vafile, "CHUNK", 7)  # several scans
        got = ask(spark, rows)
    assert got == brute(rows)
    assert seen[0] == 5 * 40 and seen[1] < 40 * 2000 / 20


def test_query(spark):
    assert same(vafile.op4_exact_top_k(spark, "/root/testdata/sf0.01"), vafile.ORACLE["op4_exact_top_k"], "/root/testdata/sf0.01") == 50
