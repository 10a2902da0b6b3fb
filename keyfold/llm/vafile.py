"""Operator 4: exact top-k inner products by vector-approximation files.

The approximation file is written first: blocks of vectors with one byte for each component, the number of
its cell, beside the exact vectors in a column of their own. For each query a scan of the cells alone gives a lower and
an upper bound of every score. In the order of upper bounds, exact vectors are read in two rounds: the k first of
each query, and then those whose bound still reaches the kth exact score found. What is left is certain to be worse.

Queries go to the workers in chunks of bounded size, one scan of the cells for each; a chunk's candidates are
written and its broadcast is released before the next. A task keeps for each query the vectors that the kth
best lower bound it has seen doesn't rule out, and so does the merge of all tasks. Only candidates are joined with
the blocks of exact vectors, by block.

Vectors that are null or hold null or non-finite components take no part. Vectors of different lengths
are never compared. A row whose id equals the query's is the query's own; repeated rows of other ids are
candidates each, repeated query rows ask once (the first by its components). Null ids are candidates no
one can name, so they take no part. Scores are sums of 64-bit integers; those that do not fit are not supported.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.llm.common import shared_folder, table, written

#: Queries broadcast at a time; vectors of a block at most; bytes of a block's exact vectors at most; cells per component.
CHUNK, BLOCK, BLOCK_BYTES, CELLS = 20_000, 2048, 4 << 20, 256
#: Queries compared with a block at a time, and candidates a task holds before it drops those ruled out.
TOGETHER, HELD = 512, 1 << 20
FILE = "block binary, length int, ids binary, low binary, step binary, cells binary, exact binary"
CANDIDATE = "query_id bigint, block binary, row int, lower double, upper double"


def quantise(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v array<bigint>): floor(256 * x) of every component, valid rows only."""
    e = F.col(f"`{embedding}`")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.where(F.col(f"`{vec_id}`").isNotNull() & e.isNotNull() & F.coalesce(fine, F.lit(False)))
        .select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.transform(e, lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("bigint")).alias("v"))
    )


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) for each length of vector in a batch."""
    ids, column = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
    offs = column.offsets.to_numpy()
    flat, length = column.values.to_numpy(zero_copy_only=False), np.diff(offs)
    for d in np.unique(length):
        if d:
            at = np.flatnonzero(length == d)
            yield ids[at], flat[offs[:-1][at][:, None] + np.arange(d)]


def cells_of(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, step, cells): a component's cell c holds the whole numbers low + step * c and up to step - 1 more."""
    low = v.min(axis=0)
    step = (v.max(axis=0) - low) // CELLS + 1
    return low, step, ((v - low) // step).astype(np.uint8)


def approximation_file(vectors: DataFrame) -> DataFrame:
    """The written blocks; which vectors share a block makes no difference to results."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def blocks(d: int, all_of_it: bool) -> Iterator[pa.RecordBatch]:
            ids, v = (np.concatenate(x) for x in zip(*held.pop(d), strict=True))
            most = max(1, min(BLOCK, BLOCK_BYTES // (8 * d)))
            end = len(ids) if all_of_it else len(ids) // most * most
            for first in range(0, end, most):
                some = slice(first, min(first + most, end))
                low, step, cells = cells_of(v[some])
                packed = [uuid.uuid4().bytes, *(np.ascontiguousarray(x).tobytes() for x in (ids[some].astype(np.int64), low, step, cells, v[some]))]
                columns = [pa.array([x], pa.binary()) for x in packed]
                yield pa.RecordBatch.from_arrays([columns[0], pa.array([d], pa.int32()), *columns[1:]], names=["block", "length", "ids", "low", "step", "cells", "exact"])
            if end < len(ids):
                held[d] = [(ids[end:], v[end:])]

        for batch in batches:
            for ids, v in rows_of(batch):
                held.setdefault(v.shape[1], []).append((ids, v))
                if sum(len(x) for x, _ in held[v.shape[1]]) >= BLOCK:
                    yield from blocks(v.shape[1], False)
        for d in list(held):
            yield from blocks(d, True)

    return written(vectors.select("vec_id", "v").mapInArrow(run, FILE), "cells")


@dataclass
class Found:
    """Candidates: query number, block number, row, lower and upper bound of the score."""

    q: np.ndarray
    block: np.ndarray
    row: np.ndarray
    lower: np.ndarray
    upper: np.ndarray

    def take(self, at: np.ndarray) -> Found:
        return Found(self.q[at], self.block[at], self.row[at], self.lower[at], self.upper[at])

    def possible(self, k: int) -> Found:
        """Those that the kth best lower bound of their query doesn't rule out."""
        order = np.lexsort((-self.lower, self.q))
        q, lower = self.q[order], self.lower[order]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, len(q)])
        kth = np.where(size >= k, lower[np.minimum(first + k, len(q)) - 1], -np.inf) if len(q) else np.zeros(0)
        return self.take(order[self.upper[order] >= np.repeat(kth, size)])


def scan(q: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, low: np.ndarray, step: np.ndarray, cells: np.ndarray, k: int) -> Found:
    """The candidates of one block, from its cells: q @ edge is the score at the cells' lower edges, and what lies within
    cells can add to it or take from it by a query's own constant. Bounds are widened by what floats may lose."""
    edge = (low + step * cells.astype(np.int64)).astype(np.float64)
    base = q @ edge.T
    base[query_ids[:, None] == ids[None, :]] = -np.inf
    widest = np.abs(np.stack([low, low + step * CELLS])).max(axis=0).astype(np.float64)
    loss = 1e-12 * (np.abs(q) @ widest) * (1 + len(low) / 100)
    less, more = np.minimum(q, 0) @ (step - 1.0) - loss, np.maximum(q, 0) @ (step - 1.0) + loss
    n = base.shape[1]
    kth = -np.partition(-base, k - 1, axis=1)[:, k - 1] if n > k else np.full(len(q), -np.inf)
    i, row = np.nonzero((base + more[:, None] >= (kth + less)[:, None]) & (base > -np.inf))
    return Found(i, np.zeros(len(i), np.int64), row, base[i, row] + less[i], base[i, row] + more[i])


def candidates(blocks: DataFrame, held, k: int) -> DataFrame:
    """CANDIDATE rows of one chunk of queries: (query id, vector) by length in the broadcast."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[Found]] = {}
        names: list[bytes] = []
        for batch in batches:
            for name, d, *packed in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if d not in held.value:
                    continue
                ids, low, step = (np.frombuffer(x, np.int64) for x in packed[:3])
                cells = np.frombuffer(packed[3], np.uint8).reshape(-1, d)
                query_ids, q = held.value[d]
                for at in range(0, len(q), TOGETHER):
                    new = scan(q[at : at + TOGETHER], query_ids[at : at + TOGETHER], ids, low, step, cells, k)
                    found.setdefault(d, []).append(Found(new.q + at, new.block + len(names), new.row, new.lower, new.upper))
                names.append(name)
                if sum(len(x.q) for x in found[d]) >= HELD:
                    found[d] = [joined(found[d]).possible(k)]
        for d, parts in found.items():
            x = joined(parts).possible(k)
            yield pa.RecordBatch.from_arrays([pa.array(held.value[d][0][x.q]), pa.array(names, pa.binary()).take(pa.array(x.block)), pa.array(x.row.astype(np.int32)), pa.array(x.lower), pa.array(x.upper)], names=["query_id", "block", "row", "lower", "upper"])

    return blocks.select("block", "length", "ids", "low", "step", "cells").mapInArrow(run, CANDIDATE)


def joined(parts: list[Found]) -> Found:
    return Found(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("q", "block", "row", "lower", "upper")))


def read(wanted: DataFrame, blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, block, row, vec_id, score, upper): the exact scores of the wanted candidates."""

    def run(rows: pa.Table, block: pa.Table) -> pa.Table:
        query_id, row = (rows[c].combine_chunks().to_numpy() for c in ("query_id", "row"))
        d = block["length"][0].as_py()
        ids = np.frombuffer(block["ids"][0].as_py(), np.int64)
        exact = np.frombuffer(block["exact"][0].as_py(), np.int64).reshape(-1, d)
        q = rows["q"].combine_chunks()
        score = np.einsum("ij,ij->i", q.values.to_numpy(zero_copy_only=False)[q.offsets.to_numpy()[:-1][:, None] + np.arange(d)], exact[row]) if len(row) else np.zeros(0, np.int64)
        return pa.table({"query_id": query_id, "block": rows["block"], "row": row, "vec_id": ids[row], "score": score, "upper": rows["upper"]})

    rows = wanted.join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").select("query_id", "block", "row", "upper", "q")
    some = blocks.join(wanted.select("block").distinct(), "block", "left_semi").select("block", "length", "ids", "exact")
    schema = "query_id bigint, block binary, row int, vec_id bigint, score bigint, upper double"
    return rows.groupBy("block").cogroup(some.groupBy("block")).applyInArrow(run, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other vectors, ties to the smaller vec_id.

    Both inputs are (vec_id, v) as quantise() makes them.
    """
    spark = vectors.sparkSession
    blocks = approximation_file(vectors)
    asked = written(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    chunks = -(-asked.count() // CHUNK)
    path = f"{shared_folder(spark)}/candidates-{uuid.uuid4().hex}"
    spark.createDataFrame([], CANDIDATE).write.parquet(path)
    for c in range(chunks):
        by_length: dict[int, list] = {}
        for r in asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c).collect():  # about CHUNK rows
            by_length.setdefault(len(r.v), []).append(r)
        held = spark.sparkContext.broadcast({d: (np.array([r.vec_id for r in rs], np.int64), np.array([r.v for r in rs], np.float64)) for d, rs in by_length.items()})
        candidates(blocks, held, k).write.mode("append").parquet(path)
        held.unpersist()
    all_of_them = spark.read.schema(CANDIDATE).parquet(path)

    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("lower")))
    bound = all_of_them.withColumn("nth", nth).where(F.col("nth") == k).select("query_id", F.col("lower").alias("least"))
    left = all_of_them.join(bound, "query_id", "left").where(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
    in_order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("upper"), "block", "row"))
    left = written(left.select("query_id", "block", "row", "upper", in_order.alias("nth")), "bounds")
    first = written(read(left.where(F.col("nth") <= k), blocks, asked), "read")
    kth = first.groupBy("query_id").agg(F.min("score").alias("kth"))  # of the k first, if there are so many
    rest = left.where(F.col("nth") > k).join(kth, "query_id").where(F.col("upper") >= F.col("kth"))
    second = read(rest.select("query_id", "block", "row", "upper"), blocks, asked)
    exact = first.unionByName(second)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantise(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


ORACLE = {
    "op4_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
