"""Operator 9: exact byte repeats by longest-previous-factor arrays; the first copy stays.

The longest previous factor of a position is the longest string that starts there and also starts at an
earlier position. In suffix order it is the longer of the common prefixes with the nearest suffixes, before
and after, that have a smaller position. A byte goes if a position whose factor has at least `length` bytes
covers it. Only suffixes with a common anchor (see repeats) can share so much, so each block of contexts
is put in suffix order by itself, as far as `length` bytes, and the array is made there (see suffixes).
Equal contexts are one entry, at their first place: all other places have the first one before them, so
their factors span the context.

Positions are ordered by doc_id (null first), then by the hash of the text, then by the start; rows with equal
doc_id and text are one document and all get its result. Null and empty texts have nothing to remove.
Strings are bytes of UTF-8, so what is left may start or end within a character.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import kernels as K
from keyfold.llm import repeats as R
from keyfold.llm.common import table
from keyfold.llm.suffixes import Order, longest_previous_factors

GRAM = 28


def byte_symbols(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return buf, offs


def byte_values(symbols: np.ndarray) -> np.ndarray:
    return K._BYTE[symbols]


def byte_strings(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return body, offs[:-1], np.diff(offs)


def unit(length: int) -> R.Unit:
    return R.Unit(length, min(GRAM, max(1, length // 2)), True, 8 if length >= 8 else 1, length, byte_symbols, byte_values, None, byte_strings)


def with_previous(length: int) -> R.Method:
    """Windows whose longest previous factor has `length` bytes."""

    def method(order: Order, first: np.ndarray, windows: np.ndarray) -> np.ndarray:
        return longest_previous_factors(order) >= length

    return method


def remove_repeats(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, starts, ends, kept) of every row of docs: the removed runs (byte offsets, from
    and up to), and what is left as binary."""
    keyed, u = R.keyed(docs, doc_id, text), unit(length)
    joined = keyed.join(R.repeated_spans(keyed, u, with_previous(length)), ["d", "k"], "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, offs in R.documents(batch, 1):
                part = batch.slice(first, end - first)
                doc, opens, closes = R.covered(part.column(2), offs, u)
                kept = buf[~R.marked(opens, closes, len(buf))]
                removed = np.bincount(doc, closes - opens, minlength=end - first).astype(np.int64)
                runs = np.bincount(doc, minlength=end - first)
                at = np.r_[0, np.cumsum(np.diff(offs) - removed)]
                body = pa.BinaryArray.from_buffers(pa.binary(), end - first, [None, pa.py_buffer(at.astype(np.int32).tobytes()), pa.py_buffer(kept.tobytes())])
                lists = [K.list_array(x - offs[doc], runs, pa.int64()) for x in (opens, closes)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offs)), pa.array(removed), *lists, body], names=["d", "n_bytes", "n_removed", "starts", "ends", "kept"])

    out = joined.select("d", "text", "spans").mapInArrow(run, "d bigint, n_bytes bigint, n_removed bigint, starts array<bigint>, ends array<bigint>, kept binary")
    return out.select(R.original_id(), "n_bytes", "n_removed", "starts", "ends", "kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), 100)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = {
    "op9_suffix_dedup": """
        WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM t)),
        later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
        turn AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM later),
        run AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM turn) GROUP BY doc_id, r),
        gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM run
                UNION ALL SELECT t.doc_id, coalesce(max(run.b), 0), any_value(length(h) // 2) FROM t LEFT JOIN run ON run.doc_id = t.doc_id GROUP BY t.doc_id),
        kept AS (SELECT gap.doc_id, string_agg(substr(t.h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS k FROM gap JOIN t ON t.doc_id = gap.doc_id GROUP BY gap.doc_id),
        sums AS (SELECT doc_id, sum(b - a) AS n, count(*) AS s FROM run GROUP BY doc_id)
        SELECT t.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256
        FROM t JOIN kept ON kept.doc_id = t.doc_id LEFT JOIN sums ON sums.doc_id = t.doc_id"""
}
