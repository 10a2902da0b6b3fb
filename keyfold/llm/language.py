"""Operator 1: language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

Counts of words and word pairs are quantised to levels, level j for counts of about BASE ** (j - 1), and an
n-gram of level j is put into a Bloom filter j times, as (n-gram, 1) ... (n-gram, j). All bits of an entry are
in one 64-bit word, so that a probe is one look at memory. The filter is made in shards by hash, each by one task from the n-grams that fall to it, and broadcast to the workers. A count is
read back by probing (n-gram, 1), (n-gram, 2) ... until one is missing: the level is never underestimated
and overestimated with the filter's small false-positive rate at each step. A pair's probability is
smoothed toward its word's: (c(v, w) + PRIOR * p(w)) / (c(v) + PRIOR).

The filter takes BITS bits for each entry whatever the size of the input, so the false-positive rate stays
as it is. Up to MOST_BYTES it is broadcast. A larger one stays where it was written: each piece of documents
sends its distinct n-grams to the slices of the filter they fall to, a slice of SLICE shards answers with
levels, and the levels meet the piece's texts again. Both ways give the same scores.

The base score uses exact counts. They stay distributed: words that make at least 1 in COMMON of all
tokens (at most COMMON words) are broadcast, a document's other words meet their counts in a join.

A null or empty text is the end alone. A null doc_id is held out. Rows with equal doc_id and text learn and
are scored each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import kernels as K
from keyfold.llm.common import bounded_batches, table, written

BASE, PRIOR = 1.5, 60.0
BITS, PROBES, MOST_BYTES = 8, 4, 1 << 27
#: Tokens that make one shard; tokens counted together before they leave a task; frequent words.
SHARD_TOKENS, TOGETHER, COMMON = 400_000, 2_000_000, 100_000
#: Shards that answer together when the filter isn't broadcast, and n-grams looked up at a time.
SLICE, LOOKED_UP = 4, 1 << 20
START, END = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)
PAIR = np.uint64(0xD6E8FEB86659FD93)
LOW48 = np.uint64((1 << 48) - 1)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, d, k, held_out, text): d and k tell documents apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = F.col("doc_id").cast("bigint")
    held = F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return docs.select(ids.alias("doc_id"), F.coalesce(ids, F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("k"), held.alias("held_out"), text.alias("text"))


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number in each document) of the tokens: a document's words in lower case, then the end."""
    h, doc, _, _ = K.words(buf, offs, lower=True)
    n = np.bincount(doc, minlength=len(offs) - 1)
    ends = np.cumsum(n + 1) - 1
    out = np.full(len(h) + len(n), END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = h
    return out, n + 1


def pairs(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The token before each token, START before the first."""
    before = np.r_[START, t[:-1]]
    before[np.cumsum(n) - n] = START
    return before


def pair_hash(before: np.ndarray, t: np.ndarray) -> np.ndarray:
    return K.mix(before * PAIR + t)


def texts(batches: Iterable[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of batches: (rows, buf, offs)."""
    for batch in batches:
        buf, offs = K.text_buffer(batch.column(column))
        for first, end in K.pieces(offs):
            yield batch.slice(first, end - first), buf[offs[first] : offs[end]], offs[first : end + 1] - offs[first]


def word_counts(train: DataFrame) -> DataFrame:
    """(h, c): the exact count of every token; START with the number of documents is left to the filter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for _, buf, offs in texts(batches):
            held.append(tokens(buf, offs)[0])
            size += len(held[-1])
            if size >= TOGETHER:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return train.select("text").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("c"))


@dataclass
class Filter:
    """The filter's words, and where each shard's begin and how many they are."""

    words: np.ndarray
    first: np.ndarray
    size: np.ndarray

    def level(self, h: np.ndarray) -> np.ndarray:
        """The level of each n-gram: 0 if it isn't there."""
        out, at, j = np.zeros(len(h), np.int64), np.arange(len(h)), 1
        shard = shard_of(h, len(self.first))
        first, size = self.first[shard], self.size[shard]
        while len(at) and j <= 120:
            word, mask = probe(h, j, size)
            there = (self.words[first + word] & mask) == mask
            at, h, first, size = at[there], h[there], first[there], size[there]
            out[at] = j
            j += 1
        return out


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a 48-bit n-gram hash."""
    return ((h >> np.uint64(16)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def probe(h: np.ndarray, level: int, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The word of a shard of `size` words and the bits in it that stand for (h, level)."""
    x = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level))
    word = (x >> np.uint64(32)) * np.asarray(size, np.uint64) >> np.uint64(32)
    mask = np.zeros(len(h), np.uint64)
    for p in range(PROBES):
        mask |= np.uint64(1) << (x >> np.uint64(6 * p) & np.uint64(63))
    return word.astype(np.int64), mask


def level_of(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(BASE) + 1e-9).astype(np.int64)


def counts_of_levels() -> np.ndarray:
    """The count a level stands for: the middle of the whole numbers that have it."""
    j = np.arange(1, 122)
    low, high = np.ceil(BASE ** (j - 1) - 1e-9), np.maximum(np.ceil(BASE**j - 1e-9) - 1, 0)
    return np.r_[0.0, np.where(high >= low, (low + np.minimum(high, BASE**j)) / 2, low)]


def six_bytes(h: np.ndarray) -> np.ndarray:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def of_six_bytes(packed: Iterable[bytes]) -> np.ndarray:
    six = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(six), 8), np.uint8)
    wide[:, :6] = six
    return wide.view("<u8").ravel()


def filter_shards(train: DataFrame, n_tokens: int) -> tuple[DataFrame, int]:
    """The written filter (shard, words) and the number of its shards: counts words, START and pairs of the
    training texts by shards and makes each shard's bits. A shard without n-grams has no row.

    A task sends each shard one row of packed counts for every TOGETHER tokens it has read.
    """
    shards = max(16, -(-n_tokens // SHARD_TOKENS))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(shard_of(h, shards), np.arange(shards + 1))
            six = six_bytes(h)
            n = n.astype("<u4")
            full = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([six[cut[s] : cut[s + 1]].tobytes() for s in full], pa.binary()), pa.array([n[cut[s] : cut[s + 1]].tobytes() for s in full], pa.binary())], names=["shard", "h", "n"])

        for rows, buf, offs in texts(batches):
            t, n = tokens(buf, offs)
            held += [t & LOW48, pair_hash(pairs(t, n), t) & LOW48, np.full(rows.num_rows, START & LOW48)]
            size += len(t)
            if size >= TOGETHER:
                yield sent()
                held, size = [], 0
        if size:
            yield sent()

    def build(group: pa.Table) -> pa.Table:
        h, back = np.unique(of_six_bytes(group["h"].to_pylist()), return_inverse=True)
        levels = level_of(np.maximum(np.bincount(back, np.frombuffer(b"".join(group["n"].to_pylist()), "<u4")), 1))
        size = 1 + BITS * int(levels.sum()) // 64
        words = np.zeros(size, np.uint64)
        for j in range(1, int(levels.max()) + 1):
            word, mask = probe(h[levels >= j], j, size)
            np.bitwise_or.at(words, word, mask)
        return pa.table({"shard": pa.array([group["shard"][0].as_py()], pa.int32()), "words": pa.array([words.astype("<u8").tobytes()], pa.binary())})

    sent = train.select("text").mapInArrow(count, "shard int, h binary, n binary")
    made = sent.groupBy("shard").applyInArrow(build, "shard int, words binary")
    return written(made, "filter"), shards


def assembled(blocks: dict[int, bytes], shards: int) -> Filter:
    """The filter of the given shards; a shard that isn't given has one empty word."""
    empty = b"\0" * 8
    given = sorted(blocks)
    first, size = np.zeros(shards, np.int64), np.ones(shards, np.int64)
    size[given] = [len(blocks[s]) // 8 for s in given]
    first[given] = 1 + np.cumsum(size[given]) - size[given]
    return Filter(np.frombuffer(b"".join([empty, *(blocks[s] for s in given)]), "<u8"), first, size)


def gathered(made: DataFrame, shards: int) -> Filter:
    """The whole filter, in the driver."""
    return assembled({row.shard: bytes(row.words) for row in made.toLocalIterator()}, shards)


def build_filter(train: DataFrame, n_tokens: int) -> Filter:
    return gathered(*filter_shards(train, n_tokens))


SCORED = "doc_id bigint, d bigint, k bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double"


@dataclass
class Scorer:
    """Scores pieces of documents, given a function that reads the levels of n-grams."""

    n_tokens: int
    n_words: int

    def of(self, rows: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray, level: Callable[[np.ndarray], np.ndarray], words: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        whole, value = self.n_tokens + 0.1 * (self.n_words + 1), counts_of_levels()
        t, n = tokens(buf, offs)
        doc = np.repeat(np.arange(len(n)), n)
        single, at = np.unique(t, return_inverse=True)
        c = found(single, words, counts)[at]
        base = np.where(c > 0, np.log10((c + 0.1) / whole), 0.0)
        q = value[level(single & LOW48)]
        before = pairs(t, n)
        start = value[level(np.array([START & LOW48]))][0]
        first = np.cumsum(n) - n
        qv = np.r_[start, q[at][:-1]]
        qv[first] = start
        pair, pair_at = np.unique(pair_hash(before, t) & LOW48, return_inverse=True)
        both = np.minimum(value[level(pair)][pair_at], np.minimum(qv, q[at]))
        p = (both + PRIOR * ((q + 0.1) / whole)[at]) / (qv + PRIOR)
        sums = [np.bincount(doc, x, minlength=len(n)) for x in (base, np.log10(np.minimum(p, 1.0)))]
        known = np.bincount(doc, c > 0, minlength=len(n)).astype(np.int64)
        return pa.RecordBatch.from_arrays([*rows.columns[:4], pa.array(n.astype(np.int64)), pa.array(known), *map(pa.array, sums)], names=["doc_id", "d", "k", "held_out", "n_tokens", "known", "base", "score"])


def scores(docs: DataFrame, ngrams, common, scorer: Scorer) -> DataFrame:
    """(doc_id, d, k, held_out, n_tokens, known, base, score) of every row; known and base cover common words only."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in texts(batches, 4):
            yield scorer.of(rows, buf, offs, ngrams.value.level, *common.value)

    return docs.mapInArrow(run, SCORED)


def probes_of(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The distinct n-grams that scoring a piece asks for, in order; slices follow one another in it."""
    return np.unique(np.concatenate([t & LOW48, pair_hash(pairs(t, n), t) & LOW48, [START & LOW48]]))


def scores_by_slices(docs: DataFrame, made: DataFrame, shards: int, common, scorer: Scorer) -> DataFrame:
    """The same as scores(), with a filter that no worker holds: n-grams go to its slices, levels come back.

    A piece's name is random, so what is sent is written before it is read twice.
    """
    slices = -(-shards // SLICE)

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in texts(batches, 4):
            h = probes_of(*tokens(buf, offs))
            cut = np.searchsorted(shard_of(h, shards) // SLICE, np.arange(slices + 1))
            full, six = np.flatnonzero(np.diff(cut)), six_bytes(h)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rows)
            packed = [sink.getvalue().to_pybytes(), *(six[cut[s] : cut[s + 1]].tobytes() for s in full)]
            yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().bytes] * len(packed), pa.binary()), pa.array([-1, *full], pa.int32()), pa.array(packed, pa.binary())], names=["piece", "slice", "packed"])

    def answer(sent: pa.Table, blocks: pa.Table) -> pa.Table:
        f = assembled(dict(zip(blocks["shard"].to_pylist(), blocks["words"].to_pylist(), strict=True)), shards)
        packed = sent["packed"].to_pylist()
        h = of_six_bytes(packed)
        levels = b"".join(f.level(h[i : i + LOOKED_UP]).astype(np.uint8).tobytes() for i in range(0, len(h), LOOKED_UP))
        ends = np.cumsum([len(x) // 6 for x in packed], dtype=np.int64)
        return pa.table({"piece": sent["piece"], "slice": sent["slice"], "packed": pa.array([levels[e - len(x) // 6 : e] for x, e in zip(packed, ends, strict=True)], pa.binary())})

    def finish(group: pa.Table) -> pa.Table:
        of = dict(zip(group["slice"].to_pylist(), group["packed"].to_pylist(), strict=True))
        (rows,) = pa.ipc.open_stream(of.pop(-1))
        buf, offs = K.text_buffer(rows.column(4))
        h = probes_of(*tokens(buf, offs))
        levels = np.frombuffer(b"".join(of[s] for s in sorted(of)), np.uint8).astype(np.int64)
        if len(h) != len(levels):
            raise ValueError(f"{len(levels)} levels for {len(h)} n-grams")
        return pa.Table.from_batches([scorer.of(rows, buf, offs, lambda x: levels[np.searchsorted(h, x)], *common.value)])

    sent = written(docs.mapInArrow(ask, "piece binary, slice int, packed binary"), "asked")
    by_slice = made.withColumn("slice", F.floor(F.col("shard") / SLICE).cast("int")).groupBy("slice")
    levels = sent.where("slice >= 0").groupBy("slice").cogroup(by_slice).applyInArrow(answer, "piece binary, slice int, packed binary")
    return sent.where("slice < 0").unionByName(levels).groupBy("piece").applyInArrow(finish, SCORED)


def found(t: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of tokens among sorted words, 0 for others."""
    if not len(words):
        return np.zeros(len(t), np.int64)
    at = np.minimum(np.searchsorted(words, t), len(words) - 1)
    return np.where(words[at] == t, counts[at], 0)


def rare_words(docs: DataFrame, common) -> DataFrame:
    """(d, k, h, n): the other words of each row and how often."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = common.value
        for rows, buf, offs in texts(batches, 2):
            t, n = tokens(buf, offs)
            doc = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((t, doc))
            t, doc = t[order], doc[order]
            new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (doc[1:] != doc[:-1])]) if len(t) else np.zeros(0, np.int64)
            many = np.diff(np.r_[new, len(t)])
            rare = found(t[new], words, counts) == 0
            new, many = new[rare], many[rare]
            d, k = (np.asarray(rows.column(i))[doc[new]] for i in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d, k, t[new].view(np.int64), many)], names=["d", "k", "h", "n"])

    return docs.select("d", "k", "text").mapInArrow(run, "d bigint, k bigint, h bigint, n bigint")


def language_model_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text),
    learned from those that aren't held out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = keyed(docs)
    train = rows.where(~F.col("held_out"))
    counts = written(word_counts(train), "word-counts")
    n_tokens, n_words = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    often = counts.where(F.col("c") * COMMON >= n_tokens).collect()  # at most COMMON rows
    h, c = np.array([r.h for r in often], np.int64).view(np.uint64), np.array([r.c for r in often], np.int64)
    common = spark.sparkContext.broadcast((np.sort(h), c[np.argsort(h)]))
    scorer = Scorer(n_tokens, n_words)
    made, shards = filter_shards(train, n_tokens)
    if (made.agg(F.sum(F.length("words"))).first()[0] or 0) <= MOST_BYTES:
        scored = scores(rows, spark.sparkContext.broadcast(gathered(made, shards)), common, scorer)
    else:
        scored = scores_by_slices(rows, made, shards, common, scorer)

    log = lambda c: F.log10((c + 0.1) / F.lit(n_tokens + 0.1 * (n_words + 1)))
    c = F.coalesce("c", F.lit(0))
    rare = rare_words(rows, common).join(counts, "h", "left").select("d", "k", F.when(c > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * log(c)).alias("base"), F.lit(0).alias("one"))
    ones = rows.select("d", "k", F.lit(0).cast("bigint").alias("known"), F.lit(0.0).alias("base"), F.lit(1).alias("one"))
    by_doc = rare.unionByName(ones).groupBy("d", "k").agg(F.sum("known").alias("more"), F.sum("base").alias("rest"), F.sum("one").alias("m"))
    out = scored.join(by_doc, ["d", "k"])
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + (F.col("more") / F.col("m")).cast("bigint")).alias("n_known"),
        F.lit(n_tokens).cast("bigint").alias("train_tokens"), (F.col("base") + F.col("rest") / F.col("m")).alias("base_score"), "score",
    )


def op1_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"))
