from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyfold.llm import bpe
from tests.llm.conftest import odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="aethrnos '\n.,0123", max_size=60), st.text(alphabet="ab", max_size=80)), min_size=1, max_size=4))
def test_ids_are_the_librarys(texts):
    t = Tokenizer.from_file(PATH)
    flat, counts = bpe.vocabulary(PATH).encode(texts)
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert flat.tolist() == [i for ids in want for i in ids]
    assert counts.tolist() == list(map(len, want))


def test_special_tokens_and_spaces(library):
    texts = ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "\x1c\x1d\x85 x ᠎ y", "  \n\n a  ", "it's IT'S we'll"]
    flat, _ = bpe.vocabulary(PATH).encode(texts)
    assert flat.tolist() == [i for e in library.encode_batch(texts, add_special_tokens=False) for i in e.ids]


def test_merging_step_by_step_and_together_agree():
    v = bpe.vocabulary(PATH)
    words = [b" aaaaaaa", b" thhehesh", b"tionating", "ñandúes".encode(), b"x"]
    assert v.merged_together(words) == [v.merged(w) for w in words]


def test_odd_documents(odd, library):
    out = bpe.decode(bpe.encode(odd, PATH), PATH)
    for r in out.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    assert out.count() == len(odd_rows())


def test_other_columns_stay(clashing, nothing):
    out = bpe.encode(clashing, PATH)
    assert [c for c in out.columns if c != "ids"] == [c for c in clashing.columns if c != "ids"]
    assert out.select(F.sum(F.size("ids"))).first()[0] > 0
    assert bpe.encode(nothing, PATH).count() == 0


def test_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(1, [110, None, 34]), (2, None), (3, [])], "i int, ids array<int>")
    assert {r.i: r.decoded for r in bpe.decode(df, PATH).collect()}[2] == ""


def test_query(spark, library):
    rows = {r.doc_id: r for r in bpe.op3_bpe_encode_decode(spark, "/root/testdata/sf0.001").collect()}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        got = rows[r.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
