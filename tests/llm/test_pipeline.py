from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as C

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    """Each stage against what its operator says on its own input."""
    from keyfold.llm.common import written
    from tests.llm.test_near import brute
    from tests.llm.test_repeats import brute_words

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs]
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        if name != "BPE encoding":
            assert docs.columns == seen[0].columns, name
        seen.append(docs)
    raw, good, near, cut, mixed, tokens = ([tuple(r) for r in d.collect()] for d in seen)
    assert 0.5 * len(raw) < len(good) < len(raw) and set(good) <= set(raw)
    want = sorted(d for d, _, _, kept in brute([(r[0], r[1]) for r in good], 5, 80) if kept)
    assert sorted(r[0] for r in near) == want
    texts = {r[0]: r for r in cut}
    for (d, _), (w, gone) in zip(sorted((r[0], r[1]) for r in near), brute_words(sorted((r[0], r[1]) for r in near), 35), strict=True):
        assert texts[d][1].encode().split() == [x for x, g in zip(w, gone, strict=True) if not g]
        assert texts[d][4] == len(texts[d][1])
    assert {r[0] for r in mixed} <= {r[0] for r in cut} and max(mixed.count(r) for r in mixed) == 2
    assert abs(sum(len(r[1].split()) for r in mixed) / sum(len(r[1].split()) for r in cut) - 1.5) < 0.1
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    of = {r[0]: r[1] for r in cut}
    assert len(tokens) == len(mixed)
    for doc, _, _, n, ids, sha in tokens:
        assert ids == t.encode(of[doc], add_special_tokens=False).ids and n == len(ids) and sha == hashlib.sha256(of[doc].encode()).hexdigest()


@pytest.mark.parametrize("table", ["clashing", "nothing"])
def test_odd_documents(request, spark, table):
    docs = request.getfixturevalue(table)
    for name, stage in C.STAGES:
        out = stage(spark, docs, SF)
        if name != "BPE encoding":
            assert out.columns == docs.columns, name
        assert out.count() <= docs.count() * 2


def test_rows_that_repeat_an_id(spark, odd):
    """Rows of one id and text are one; rows of one id and other texts are documents of their own; no id, no duplicate."""
    left = C.near_dedup(spark, odd.where("doc_id in (6, 7, 8, 15) or doc_id is null"), SF)
    assert left.columns == odd.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(15) == 2 and ids.count(8) == 1 and ids.count(None) == 2 and 6 in ids and 7 not in ids


def test_run(spark):
    assert C.run(spark, SF).count() > 50
