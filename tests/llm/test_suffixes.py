"""Longest previous factors, matches and greedy factors against plain Python."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from keyfold.llm import lempel, repeats, suffix
from keyfold.llm import suffixes as S


def shared(x, y):
    k = 0
    while k < min(len(x), len(y)) and x[k] == y[k]:
        k += 1
    return k


def batch(rng, unit, texts):
    """Contexts of one document each, in blocks 0 and 1, sorted by block."""
    h = np.sort(rng.integers(0, 2, len(texts)))
    n = [len(unit.symbols(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0]) - unit.length + 1 for t in texts]
    zero = np.zeros(len(texts), np.int64)
    return h, pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.arange(len(texts))), pa.array(zero), pa.array(np.array(n) - 1), pa.array(texts, pa.binary())], names=["h", "d", "k", "ab", "bytes"])


@pytest.mark.parametrize("seed", range(40))
def test_previous_factors(seed):
    rng = np.random.default_rng(seed)
    u = suffix.unit(int(rng.integers(2, 20)))
    texts = [bytes(rng.integers(97, 99, int(rng.integers(u.length, 3 * u.length)), dtype=np.uint8)) for _ in range(int(rng.integers(1, 8)))]
    h, rows = batch(rng, u, texts)
    order, first, windows, _ = repeats.suffix_order(rows, u)
    subs = [(b, t[i : i + u.length]) for b, t in zip(h, texts, strict=True) for i in range(len(t) - u.length + 1)]
    want = [max((shared(x, y) for c, y in subs[:i] if b == c), default=0) for i, (b, x) in enumerate(subs)]
    assert S.longest_previous_factors(order).tolist() == want
    assert suffix.with_previous(u.length)(order, first, windows).tolist() == [w >= u.length for w in want]


@pytest.mark.parametrize("seed", range(40))
def test_greedy_factors(seed):
    rng = np.random.default_rng(seed)
    u = lempel.unit(int(rng.integers(2, 9)))
    most = u.reach
    words = [[b"ab"[x : x + 1] * (1 + x) for x in rng.integers(0, 2, int(rng.integers(u.length, most + 1)))] for _ in range(int(rng.integers(1, 8)))]
    h, rows = batch(rng, u, [b" ".join(w) for w in words])
    order, first, windows, _ = repeats.suffix_order(rows, u)
    subs = [(b, w[i:]) for b, w in zip(h, words, strict=True) for i in range(len(w) - u.length + 1)]
    want = [max((shared(x, y) for j, (c, y) in enumerate(subs) if b == c and i != j), default=0) for i, (b, x) in enumerate(subs)]
    longest = S.matches(order)
    assert longest.tolist() == want
    factors = []
    for f, n in zip(first, windows, strict=True):
        at = f
        while at < f + n:
            factors.append((at, max(want[at], 1)))
            at += max(want[at], 1)
    assert sorted(zip(*(x.tolist() for x in S.parsed(longest, first, windows)), strict=True)) == sorted(factors)
    assert lempel.in_reference(u.length)(order, first, windows).tolist() == [w >= u.length for w in want]


def test_long_documents_in_stretches(monkeypatch):
    """Contexts of stretches cover the windows of the whole document, each once, under the same blocks."""
    rng = np.random.default_rng(1)
    text = rng.integers(97, 123, 5000, dtype=np.uint8)
    args = (np.zeros(1, np.int64), np.zeros(1, np.int64), text, np.array([0, len(text)]), suffix.unit(30), np.zeros(0, np.int64))
    windows = lambda: sorted((int(i), int(h)) for x in repeats.contexts_of(*args) for a, b, h in zip(x.a, x.b, x.h, strict=True) for i in range(a, b + 1))
    whole = windows()
    monkeypatch.setattr(repeats, "STRETCH", 700)
    assert windows() == whole and [i for i, _ in whole] == list(range(len(text) - 29))
