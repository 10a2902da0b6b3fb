"""Operator 10: repeated passages by relative Lempel-Ziv parsing.

Documents are factored against reference blocks: a block holds all contexts with one anchor (see repeats), and
its index is the suffix order of their words (see suffixes). The parse is greedy: at each place it takes the
longest factor that also stands elsewhere in the block, one word if there is none, and goes on where that
ends. A factor of at least `length` words is a duplicate span. Where factors end, the windows that lie over the
border are looked up in the index by themselves, so that a passage split between factors isn't missed.
Equal contexts are one entry of the block; each of their places repeats the others, so all of it goes.
Each word of a duplicate span is removed, in every copy.

Rows with equal doc_id and text are one document: they are no copies of each other, and all get its
result. Null and empty texts have no words. Removing takes a word and the white space after it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyfold.llm import kernels as K
from keyfold.llm import repeats as R
from keyfold.llm.common import table
from keyfold.llm.rules import SPACES
from keyfold.llm.suffixes import Order, matches, parsed

GRAM = 7


def word_symbols(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, doc, _, _ = K.words(buf, offs, lower=False)
    return h, np.r_[0, np.cumsum(np.bincount(doc, minlength=len(offs) - 1))]


def word_values(symbols: np.ndarray) -> np.ndarray:
    return symbols


def word_strings(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as numbers from 1, equal for equal words, with a 0 after each context."""
    starts, ends, doc = K.word_spans(body, offs)
    solid = body[~K.SPACE[body]]
    at = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(solid.tobytes())])
    n = np.bincount(doc, minlength=len(offs) - 1)
    out = np.zeros(len(starts) + len(n), np.int64)
    out[np.arange(len(starts)) + doc] = np.asarray(words.dictionary_encode().indices) + 1
    return out, np.cumsum(n) - n + np.arange(len(n)), n


def unit(length: int) -> R.Unit:
    gram = min(GRAM, max(1, length // 2))
    return R.Unit(length, gram, False, 1, 2 * length - gram, word_symbols, word_values, K.word_spans, word_strings)


def in_reference(length: int) -> R.Method:
    """Windows within long factors, and those over the borders of factors that the index holds at another place."""

    def method(order: Order, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
        longest = matches(order)
        at, size = parsed(longest, first, windows)
        long = size >= length
        gone = R.marked(at[long], (at + size)[long] - length + 1, len(longest))
        border = np.flatnonzero(~gone)
        gone[border] = longest[border] >= length
        return gone

    return method


def remove_passages(docs: DataFrame, length: int = 35, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' columns, the text without its repeated passages (null becomes empty), and n_words, n_removed of the
    text as it was. Columns of these names are replaced."""
    u = unit(length)
    plain = docs.drop("n_words", "n_removed")
    keyed = R.keyed(docs, doc_id, text)
    rest = [c for c in plain.columns if c not in (doc_id, text)]
    # without other columns the texts' shuffle is the same one that repeated_spans() needs
    rows = plain.select(*R.keyed_columns(doc_id, text), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row")) if rest else keyed
    joined = rows.join(R.repeated_spans(keyed, u, in_reference(length)), ["d", "k"], "left")
    held = ["d", *["row"][: len(rest)]]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, offs in R.documents(batch, 1):
                part = batch.slice(first, end - first)
                starts, ends, doc = K.word_spans(buf, offs)
                n = np.bincount(doc, minlength=end - first)
                _, begin, close = R.covered(part.column(0), np.r_[0, np.cumsum(n)], u)
                gone = R.marked(begin, close, len(doc))
                # a word goes with what stands up to the next word of its document
                after = np.r_[starts[1:], len(buf)]
                last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)
                after[last] = offs[1:][doc[last]]
                keep = ~R.marked(starts[gone], after[gone], len(buf))
                size = np.diff(np.r_[0, np.cumsum(keep)][offs])
                body = pa.StringArray.from_buffers(end - first, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int32).tobytes()), pa.py_buffer(buf[keep].tobytes()))
                removed = np.bincount(doc[gone], minlength=end - first)
                yield pa.RecordBatch.from_arrays([*part.columns[2:], body, pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64))], names=[*held, "kept", "n_words", "n_removed"])

    found = joined.select("spans", "text", *held)
    schema = T.StructType([*found.select(*held).schema.fields, *(T.StructField(c, t) for c, t in (("kept", T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType())))])
    out = found.mapInArrow(run, schema)
    same = {doc_id: F.when(F.col("d") != R.FIRST_ID, F.col("d")).cast(docs.schema[doc_id].dataType), text: F.col("kept")}
    return out.select(*[same.get(c, F.col(f"row.`{c}`")).alias(c) for c in plain.columns], "n_words", "n_removed")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), 35)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACES), lambda x: x != "")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.array_join(words, " ").cast("binary"), 256).alias("kept_sha256"))


ORACLE = {
    "op10_substring_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM t)),
        twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(g)) AS n FROM g) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM twice, (SELECT unnest(range(0, 35)) AS k)),
        word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
        kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) AS k, count(*) AS n FROM word ANTI JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id)
        SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id"""
}
