"""Operator 7: token ids as fixed-width bit-packed binary, written in document order and read at random.

A table of packed ids is a folder of Parquet files whose rows are shards: `image` is a
self-describing binary (see pack), `doc_ids`, `counts` say which documents it holds. Shards are
numbered by (part, shard) in ascending document order. Parquet is only the container: any store
that Spark knows can hold it, and a task reads the shards it needs.

An image is little-endian: magic b"KFB1", u32 bits per id, u64 number of ids, u32 ids per block,
u32 number of blocks, then a u64 byte offset for each block (from the image's start), then the blocks,
each starting at a whole byte: id k of a block stands in bits k*bits .. (k+1)*bits-1, lowest bit first.

Nulls and empty texts give the end id alone; null document ids come first; rows with equal ids stand in
the order of their texts' hashes; equal rows are written each; other columns are not stored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.llm import kernels as K
from keyfold.llm.common import bounded_batches, only, shared_folder, table

MAGIC, HEAD = b"KFB1", struct.Struct("<4sIQII")
BLOCK = 4096
#: Ids of a shard: it is closed by the document that reaches this number.
SHARD = 1 << 20
#: Words whose ids a worker remembers.
REMEMBERED = 1_200_000
#: Punctuation that may end a word; none of it composes with a letter before or starts a contraction.
TAIL = b".,;:!?#$%&*|"
SHARDS = "part int, shard int, n_ids bigint, doc_ids array<bigint>, counts array<bigint>, image binary"


def width(vocabulary: int) -> int:
    """Bits that the largest id of a vocabulary needs."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """The image of ids (see the module's head)."""
    ids = np.ascontiguousarray(ids, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} needs more than {bits} bits")
    n = -(-len(ids) // block)
    stride = -(-block * bits // 8)
    if bits == 16:
        body = ids.astype("<u2").tobytes()
    else:
        parts = []
        for first in range(0, len(ids), 64 * block):
            part = ids[first : first + 64 * block]
            full = np.zeros(-(-len(part) // block) * block, "<u4")
            full[: len(part)] = part
            spread = np.unpackbits(full.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
            parts.append(np.packbits(spread.reshape(-1, block * bits), axis=1, bitorder="little").tobytes())
        body = b"".join(parts)
    offsets = HEAD.size + 8 * n + stride * np.arange(n, dtype="<u8")
    return HEAD.pack(MAGIC, bits, len(ids), block, n) + offsets.astype("<u8").tobytes() + body


def unpack(image: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """ids[first : first + count] of an image; only the blocks in between are touched."""
    magic, bits, total, block, n = HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not an image of packed ids")
    count = total - first if count is None else min(count, total - first)
    if count <= 0:
        return np.zeros(0, np.uint32)
    offsets = np.frombuffer(image, "<u8", n, HEAD.size)
    b0, b1 = first // block, (first + count - 1) // block
    if bits == 16:
        return np.frombuffer(image, "<u2", count, int(offsets[b0]) + 2 * (first - b0 * block)).astype(np.uint32)
    out, stride = [], -(-block * bits // 8)
    for b in range(b0, b1 + 1, 64):
        m = min(64, b1 + 1 - b)
        raw = np.frombuffer(image, np.uint8, min(m * stride, len(image) - int(offsets[b])), int(offsets[b]))
        flat = np.unpackbits(np.pad(raw, (0, m * stride - len(raw))).reshape(m, stride), axis=1, bitorder="little")[:, : block * bits]
        wide = np.zeros((m * block, 32), np.uint8)
        wide[:, :bits] = flat.reshape(m * block, bits)
        out.append(np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel())
    return np.concatenate(out)[first - b0 * block : first - b0 * block + count]


class WordEncoder:
    """Encodes with the tokenizers library, each distinct word once per worker.

    Good for vocabularies that drop white space: no token and no step of normalising reaches over
    ASCII white space, so a text's ids are those of its words in a row. The vocabulary must fold case.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bits = width(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and t.content.startswith("<|") and not (t.lstrip or t.rstrip or t.single_word)]
        self.between, self.between_id = special[-1] if special else (None, -1)
        self.last = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def together(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, many words in one text. A word of letters alone is one piece, whose last token
        is marked as one that ends a piece; so such words stand between spaces. The others stand between special
        tokens, which the library cuts out before anything else."""
        texts = [w.decode() for w in words]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        out: list[bytes | None] = [None] * len(words)
        for k in range(0, len(plain), 256 * 32):
            many = [plain[j : j + 256] for j in range(k, min(k + 256 * 32, len(plain)), 256)]
            found = self.batch([" ".join([texts[i] for i in part]) for part in many], add_special_tokens=False)
            for part, e in zip(many, found, strict=True):
                flat = np.array(e.ids, "<u4")
                stops = np.flatnonzero(self.last[flat]) + 1
                if len(stops) == len(part) and stops[-1] == len(flat):
                    raw, at = flat.tobytes(), 0
                    for i, stop in zip(part, (4 * stops).tolist(), strict=True):
                        out[i] = raw[at:stop]
                        at = stop
        rest = [i for i, x in enumerate(out) if x is None]
        for k in range(0, len(rest), 64):
            part = rest[k : k + 64]
            flat = np.array(self.tokenizer.encode(self.between.join([texts[i] for i in part]), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(flat == self.between_id)
            if len(cuts) != len(part) - 1:
                raise ValueError("a word holds the separating token")
            raw, ends = flat.tobytes(), [*(4 * cuts).tolist(), 4 * len(flat)]
            for i, a, b in zip(part, [0, *(e + 4 for e in ends[:-1])], ends, strict=True):
                out[i] = raw[a:b]
        return out

    def alone(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def cut(self, word: bytes) -> tuple[bytes, bytes]:
        """(core, tail) whose ids in a row are the word's: case is folded by the vocabulary, and a run of
        punctuation after a letter or digit is a piece of its own."""
        core = word.rstrip(TAIL)
        if core and core != word and (chr(core[-1]).isalnum() if core[-1] < 128 else core.decode()[-1].isalpha()):
            return core.lower(), word[len(core) :]
        return word.lower(), b""

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian u32."""
        known = self.known
        # case is folded at once where no special token's string can be in the text
        cut = [(t if b"<|" in t or self.between is None else t.lower()).split() for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        new = [w for w in set().union(*cut) if w not in known]
        if self.between is None:
            odd, plain = new, []
        else:
            odd, plain = [w for w in new if b"<|" in w], [w for w in new if b"<|" not in w]
        halves = {}
        alone = []
        for w in plain:
            a, b = self.cut(w)
            if b or a != w:
                halves[w] = a, b
            else:
                alone.append(w)
        need = [h for h in {*alone, *(h for pair in halves.values() for h in pair if h)} if h not in known]
        known.update(zip(need, self.together(need), strict=True))
        known.update([(w, known[a] + known[b] if b else known[a]) for w, (a, b) in halves.items()])
        known.update([(w, self.alone(w)) for w in odd])
        out = [b"".join(map(known.__getitem__, ws)) for ws in cut]
        for w in {w for words in (new, need) for w in words if len(w) > 64}:
            del known[w]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_packed(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> None:
    """Encodes docs (doc_id, text), adds end_id to each and writes the packed ids in document order.

    One shuffle, by ranges of (doc_id, hash of the text), so that a document id held by many rows is
    split as well; each task then streams its range into shards.
    """
    bounded_batches(docs.sparkSession)
    rows = only(docs, doc_id="bigint", text="string").withColumn("h", F.xxhash64("text"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, shard = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        ids: list[int | None] = []
        size, end = 0, np.array([end_id], "<u4").tobytes()

        def close() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(held), "<u4")
            counts = [len(h) >> 2 for h in held]
            row = [[part], [shard], [len(flat)], [list(ids)], [counts], [pack(flat, enc.bits)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()), strict=True)], names=["part", "shard", "n_ids", "doc_ids", "counts", "image"])

        for batch in batches:
            for first, stop in K.pieces(K.text_buffer(batch.column(1))[1]):
                texts = [(t or "").encode() for t in batch.column(1).slice(first, stop - first).to_pylist()]
                for doc, got in zip(batch.column(0).slice(first, stop - first).to_pylist(), enc.encode(texts), strict=True):
                    held.append(got + end)
                    ids.append(doc)
                    size += (len(got) >> 2) + 1
                    if size >= SHARD:
                        yield close()
                        held, ids, size, shard = [], [], 0, shard + 1
        if held:
            yield close()

    ordered.mapInArrow(run, SHARDS).write.parquet(folder)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, start): the number of ids in all shards before.

    Only (part, shard, n_ids) is read and summed up: within parts by a window, over parts (one row for
    each writing task) by another.
    """
    sizes = shards.select("part", "shard", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = sizes.select("part", "shard", (F.sum("n_ids").over(W.partitionBy("part").orderBy("shard")) - F.col("n_ids")).alias("shard_start"))
    return inside.join(before, "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("start"))


def read_documents(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """Reads and unpacks the shards where they lie: doc_id, start (ids of all documents before it), n_tokens and
    ids (array of int), or with digests ids_crc32 (unsigned, of the ids as little-endian u32) in their place.

    Shards are not moved; the starts of the shards come to the unpacked documents by a join.
    """
    shards = spark.read.schema(SHARDS).parquet(folder)
    last, kind = ("ids_crc32", "bigint") if digests else ("ids", "array<int>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, shard, docs, counts, image = (batch.column(c)[i].as_py() for c in range(5))
                flat, counts = unpack(image), np.array(counts, np.int64)
                ends = np.cumsum(counts)
                if digests:
                    raw = memoryview(flat.astype("<u4").tobytes())
                    found = pa.array([zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)], pa.int64())
                else:
                    found = K.list_array(flat.astype(np.int32), counts, pa.int32())
                columns = [pa.array(np.full(len(docs), v, np.int32)) for v in (part, shard)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(docs, pa.int64()), pa.array(ends - counts), pa.array(counts), found], names=["part", "shard", "doc_id", "inside", "n_tokens", last])

    rows = shards.select("part", "shard", "doc_ids", "counts", "image").mapInArrow(run, f"part int, shard int, doc_id bigint, inside bigint, n_tokens bigint, {last} {kind}")
    return rows.join(shard_starts(shards), ["part", "shard"]).select("doc_id", (F.col("start") + F.col("inside")).alias("start"), "n_tokens", last)


def op7_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{shared_folder(spark)}/packed-{uuid.uuid4().hex}"
    write_packed(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_documents(spark, folder, digests=True)
