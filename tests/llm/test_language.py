from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np

from keyfold.llm import language as L
from tests.llm.conftest import odd_rows


def brute(rows):
    docs = [(d, zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0, [*(t or "").encode().lower().split(), None]) for d, t in rows]
    c = Counter(w for _, held, ws in docs if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((d, held, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for d, held, ws in docs), key=repr)


def check(df, rows):
    got = sorted(map(tuple, L.language_model_scores(df).collect()), key=repr)
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert math.isclose(g[5], w[5], rel_tol=1e-9) and math.isfinite(g[6]) and g[6] < 0
    return got


def test_odd_documents(clashing, monkeypatch):
    check(clashing, [(r[0], r[1]) for r in odd_rows()])
    monkeypatch.setattr(L, "COMMON", 5)  # nearly all words meet their counts in the join
    check(clashing, [(r[0], r[1]) for r in odd_rows()])


def test_empty_table(nothing, spark):
    assert L.language_model_scores(nothing).count() == 0
    held = spark.createDataFrame([(i, "a b") for i in range(200)], "doc_id bigint, text string").where("crc32(cast(cast(doc_id as string) as binary)) % 10 = 0")
    assert {r.train_tokens for r in L.language_model_scores(held).collect()} == {0}


def test_filter_never_loses_counts_and_rarely_adds(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(300) for _ in range(1 + (j * 7) % 40))) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = L.keyed(df)
    f = L.build_filter(train, 50_000)
    c = Counter(w for _, t in rows for w in t.split())
    import pyarrow as pa

    from keyfold.llm import kernels as K

    buf, offs = K.text_buffer(pa.array(list(c)))
    got = f.level(K.words(buf, offs, lower=True)[0] & L.LOW48)
    want = L.level_of(np.array(list(c.values())))
    assert (got >= want).all() and (got > want).mean() < 0.15
    strange = np.random.default_rng(0).integers(0, 1 << 48, 20_000, dtype=np.uint64)
    assert (f.level(strange) > 0).mean() < 0.1


def test_levels_and_their_counts():
    values = L.counts_of_levels()
    assert values[0] == 0 and values[1] == 1 and values[2] == 2
    n = np.arange(1, 5000)
    assert (np.abs(values[L.level_of(n)] - n) <= 0.3 * n).all()


def test_held_out_text_is_predicted_better_than_by_words_alone(spark):
    rows = L.op1_language_model(spark, "/root/testdata/sf0.01").where("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens + 0.2


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])


def test_filter_too_large_to_broadcast_keeps_its_bits(spark, clashing, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    of = lambda df: sorted(map(tuple, L.language_model_scores(df).collect()), key=repr)
    whole, odd = of(docs), of(clashing)
    monkeypatch.setattr(L, "MOST_BYTES", 1 << 10)
    assert of(docs) == whole and of(clashing) == odd


def exact_scores(rows):
    """(doc_id, score) from exact counts in plain Python, quantised as the filter does it."""
    value = L.counts_of_levels()
    quantised = lambda c: float(value[L.level_of(np.array([c]))[0]]) if c else 0.0
    docs = [(d, zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0, [*(t or "").encode().lower().split(), "end"]) for d, t in rows]
    train = [ws for _, held, ws in docs if not held]
    words, pairs = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in zip(["start", *ws], ws, strict=False))
    whole = sum(words.values()) + 0.1 * (len(words) + 1)
    counts = {**{w: quantised(c) for w, c in words.items()}, "start": quantised(len(train))}
    out = []
    for d, _, ws in docs:
        score = 0.0
        for v, w in zip(["start", *ws], ws, strict=False):
            q, qv = counts.get(w, 0.0), counts.get(v, 0.0)
            both = min(quantised(pairs[v, w]), q, qv)
            score += math.log10(min((both + L.PRIOR * (q + 0.1) / whole) / (qv + L.PRIOR), 1.0))
        out.append((d, score))
    return sorted(out, key=repr)


def test_scores_are_those_of_exact_counts(spark, monkeypatch):
    """With so many bits that nothing is read as seen by mistake the score is that of exact counts, by either way; with
    the usual bits it stays near."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    want = exact_scores([tuple(r) for r in docs.collect()])
    of = lambda: sorted(((r.doc_id, r.score) for r in L.language_model_scores(docs).collect()), key=repr)
    usual = of()
    assert abs(sum(s for _, s in usual) / sum(s for _, s in want) - 1) < 0.02
    monkeypatch.setattr(L, "BITS", 400)
    for most in (L.MOST_BYTES, 1 << 10):
        monkeypatch.setattr(L, "MOST_BYTES", most)
        for (d, got), (e, exact) in zip(of(), want, strict=True):
            assert d == e and math.isclose(got, exact, rel_tol=1e-6)
