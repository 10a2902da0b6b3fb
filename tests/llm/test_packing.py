from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keyfold.llm import packing
from tests.llm.conftest import odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 700), st.integers(0, 800), st.integers(0, 800), st.sampled_from([1, 7, 64, 256]))
def test_round_trip_and_random_access(bits, n, first, count, block):
    ids = np.random.default_rng(n).integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
    image = packing.pack(ids, bits, block)
    assert packing.unpack(image).tolist() == ids.tolist()
    assert packing.unpack(image, first, count).tolist() == ids[first : first + count].tolist()


def test_bad_images_and_ids():
    with pytest.raises(ValueError):
        packing.pack(np.array([8]), 3)
    with pytest.raises(ValueError):
        packing.unpack(b"0" * 40)
    assert [packing.width(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abT É'.,!é́ \n #<|>")), max_size=40))
def test_words_give_the_texts_ids(text):
    t = Tokenizer.from_file(PATH)
    got = np.frombuffer(packing.encoder(PATH).encode([text.encode()])[0], "<u4").tolist()
    assert got == t.encode(text, add_special_tokens=False).ids


def check(rows, found):
    t = Tokenizer.from_file(PATH)
    start = 0
    got = sorted(found, key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]
    want = {}
    for doc, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.setdefault(doc, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for r in got:
        assert r.start == start
        start += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(want.values())


def test_odd_documents(spark, clashing, tmp_path):
    packing.write_packed(clashing, f"file://{tmp_path}/p", PATH, end_id=1)
    check([(r[0], r[1]) for r in odd_rows()], packing.read_documents(spark, f"file://{tmp_path}/p", digests=True).collect())
    ids = packing.read_documents(spark, f"file://{tmp_path}/p").collect()
    assert all(r.ids[-1] == 1 and len(r.ids) == r.n_tokens for r in ids)


def test_empty_table(spark, nothing, tmp_path):
    packing.write_packed(nothing, f"file://{tmp_path}/p", PATH, end_id=1)
    assert packing.read_documents(spark, f"file://{tmp_path}/p").count() == 0


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    check([(r.doc_id, r.text) for r in docs], packing.op7_bit_packed_ids(spark, "/root/testdata/sf0.001").collect())
