"""Operators 9 and 10 against plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyfold.llm import lempel, repeats, suffix
from tests.llm.conftest import odd_rows, prose


def key(r):
    return (r[0] is not None, r[0] or 0)


def brute_bytes(docs, length):
    """docs: (doc_id, text), each once, in document order -> removed masks."""
    seen, out = set(), []
    for _, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        out.append((b, gone))
    return out


def brute_words(docs, length):
    words = [(t or "").encode().split() for _, t in docs]
    n = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = bytearray(len(w))
        for i in range(len(w) - length + 1):
            if n[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((w, gone))
    return out


def distinct(spark, rows):
    """Documents in the operators' order: by id, null first, then by the hash of the text."""
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id bigint, text string").withColumn("text", F.coalesce("text", F.lit("")))
    return [(r.doc_id, r.text) for r in df.distinct().orderBy("doc_id", F.xxhash64("text")).collect()]


def check_bytes(spark, df, rows, length):
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, tuple(r.starts), tuple(r.ends), bytes(r.kept)) for r in suffix.remove_repeats(df, length).collect())
    docs = distinct(spark, rows)
    want, times = Counter(), Counter((r[0], r[1] or "") for r in rows)
    for (d, t), (b, gone) in zip(docs, brute_bytes(docs, length), strict=True):
        edges = [i for i in range(len(b) + 1) if (i < len(b) and gone[i]) != (i > 0 and gone[i - 1] == 1)]
        want[d, len(b), sum(gone), tuple(edges[::2]), tuple(edges[1::2]), bytes(x for x, g in zip(b, gone, strict=True) if not g)] += times[d, t]
    assert got == want


def check_words(spark, df, rows, length):
    got = Counter((r.doc_id, r.n_words, r.n_removed, tuple(r.text.encode().split())) for r in lempel.remove_passages(df, length).collect())
    docs = distinct(spark, rows)
    want, times = Counter(), Counter((r[0], r[1] or "") for r in rows)
    for (d, t), (w, gone) in zip(docs, brute_words(docs, length), strict=True):
        want[d, len(w), sum(gone), tuple(x for x, g in zip(w, gone, strict=True) if not g)] += times[d, t]
    assert got == want


def test_odd_documents(spark, odd, clashing):
    check_bytes(spark, clashing, odd_rows(), 100)
    check_words(spark, clashing, odd_rows(), 35)
    out = lempel.remove_passages(clashing, 35)
    assert set(out.columns) == set(clashing.columns) | {"n_removed"}
    assert {r[0] for r in out.select("kept").distinct().collect()} == {"own kept"}


def test_empty_table(nothing):
    assert suffix.remove_repeats(nothing).count() == 0
    assert lempel.remove_passages(nothing).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_shared_passages_and_loops(spark, monkeypatch, hot):
    """Repeats within and between documents, nested, overlapping and periodic; with all anchors hot as well."""
    if hot:
        monkeypatch.setattr(repeats, "SAMPLE", 1)
        monkeypatch.setattr(repeats, "HOT", 1)
    p, q = prose(21, 50), prose(22, 90)
    texts = [p, prose(23, 30) + " " + p + " " + prose(24, 30), q, q[:400] + " cut " + q[400:], "ab " * 200, "ab " * 90 + "c " + "ab " * 60, p + " " + p + " " + q, q.replace(" the ", " THE ", 3), "x" * 700, prose(25, 400)]
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    check_bytes(spark, df, rows, 60)
    check_words(spark, df, rows, 20)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab ", max_size=60), min_size=1, max_size=6), st.integers(3, 9))
def test_any_texts(spark, texts, length):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    check_bytes(spark, df, rows, length)
    check_words(spark, df, rows, max(2, length // 2))


def test_queries(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r.doc_id: r for r in suffix.op9_suffix_dedup(spark, sf).collect()}
    for (d, _), (b, gone) in zip(docs, brute_bytes(docs, 100), strict=True):
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(gone)))
        assert tuple(got[d])[1:] == (len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    got = {r.doc_id: r for r in lempel.op10_substring_dedup(spark, sf).collect()}
    for (d, _), (w, gone) in zip(docs, brute_words(docs, 35), strict=True):
        assert tuple(got[d])[1:] == (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
