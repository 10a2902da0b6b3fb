from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from keyfold.llm import kernels as K

TEXT = st.text(alphabet=st.sampled_from("ab \t\n\x0b\x1cÉ漢."), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_split(texts):
    buf, offs = K.text_buffer(pa.array(texts, pa.string()))
    h, doc, starts, ends = K.words(buf, offs, lower=True)
    got = [(int(d), bytes(buf[a:b])) for d, a, b in zip(doc, starts, ends, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().split()]
    low = [w.lower() for _, w in got]
    assert len({int(x) for x in h}) == len(set(low))
    assert len(set(zip(low, h.tolist(), strict=True))) == len(set(low))


def test_null_with_bytes_and_slices():
    a = pa.array(["xx", None, "yyy", ""]).slice(1, 3)
    buf, offs = K.text_buffer(a)
    assert bytes(buf) == b"yyy" and offs.tolist() == [0, 0, 3, 3]


def test_hash_is_the_same_everywhere():
    buf = np.frombuffer(b"abcXabc", np.uint8)
    s = K.byte_sums(buf)
    a, b = K.spans_hash(s, np.array([0, 4]), np.array([3, 7]))
    assert a == b


def test_pieces_hold_all_documents():
    offs = np.array([0, 5, 5, 100, 103, 103])
    found = list(K.pieces(offs, 10))
    assert [x for a, b in found for x in range(a, b)] == list(range(5))
