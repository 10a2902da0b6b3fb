"""Operator 3: byte-level BPE encoding and decoding by speculation and verification.

Greedy longest match proposes the tokens of a word. A proposal is what merging would give if and
only if every token is what its own bytes merge to and no adjacent pair of tokens is bound to merge
across its border earlier than the tokens themselves come into being. Both are looked up or computed
for all distinct pairs of a batch at once; only the words that fail are merged step by step.

Nulls and empty texts give no ids; repeated rows are encoded each; other columns are kept as they are.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyfold.llm import kernels as K
from keyfold.llm.common import bounded_batches, only, table

#: How the ByteLevel pre-tokenizer of this kind of vocabulary cuts a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words whose ids a worker remembers, and the longest of them. More words only cost time.
REMEMBERED, REMEMBERED_CHARS = 150_000, 64
NEVER = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The tables of one vocabulary file; built once per Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items() if s not in self.special}
        size = 1 + max(*model["vocab"].values(), *self.special.values(), 0)
        self.bytes: list[bytes] = [b""] * size
        for s, i in self.ids.items():
            self.bytes[i] = s
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.rank, self.made = np.full(size, -1, np.int64), {}
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        keys = np.empty(len(pairs), np.int64)
        for k, (a, b) in enumerate(pairs):
            x, y, z = self.ids[raw(a)], self.ids[raw(b)], self.ids[raw(a + b)]
            if self.rank[z] >= 0:
                raise ValueError("two merges make the same token: not a vocabulary of this kind")
            self.rank[z], self.left[z], self.right[z], keys[k] = k, x, y, x << 32 | y
            self.made[x, y] = (k, z)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], order.astype(np.int64)
        self.rank_id = np.fromiter((self.made[k >> 32, k & 0xFFFFFFFF][1] for k in keys.tolist()), np.int64, len(keys))
        lengths: dict[bytes, set[int]] = {}
        for s in self.ids:
            lengths.setdefault(s[:2], set()).add(len(s))
        self.lengths = {p: tuple(sorted(ls, reverse=True)) for p, ls in lengths.items()}  # of the tokens that start with two bytes
        spelled = np.fromiter(map(len, self.bytes), np.int64, size)
        self.spelled_at, self.spelled_n = np.cumsum(spelled) - spelled, spelled
        self.spelled = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.byte_id = np.fromiter((self.ids[bytes([b])] for b in range(256)), np.int64, 256)
        self.whole = np.full(size, -1, np.int8)  # whether a token's bytes merge to that token; -1: not yet known
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known_keys, self.known_fit = np.zeros(0, np.int64), np.zeros(0, bool)
        self.words: dict[str, bytes] = {}

    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank at which x and y merge, NEVER if they don't."""
        key = x << 32 | y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_rank[at], NEVER)

    def fits(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether neighbours stay apart: nothing on the right edge of the first merges with anything on the
        left edge of the second while both are there. Of equal merges the leftmost comes first."""
        out = np.ones(len(first), bool)
        x, x_until, xs = first.copy(), np.full(len(first), NEVER), np.arange(len(first))
        while len(xs):
            y, y_until, ys = second[xs], np.full(len(xs), NEVER), np.arange(len(xs))
            while len(ys):
                m = self.pair_rank(x[ys], y)
                out[xs[ys[(m < x_until[ys]) & (m <= y_until) & (m < NEVER)]]] = False
                y_until, y = self.rank[y], self.left[y]
                go = (y >= 0) & out[xs[ys]]
                y, y_until, ys = y[go], y_until[go], ys[go]
            x_until, x = self.rank[x], self.right[x]
            go = (x >= 0) & out[xs]
            x, x_until, xs = x[go], x_until[go], xs[go]
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost of equals."""
        ids = [self.ids[word[i : i + 1]] for i in range(len(word))]
        n = len(ids)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        made = self.made
        heap = [(m[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := made.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or ids[i] != x or ids[j] != y:
                continue
            ids[i], gone[j], after[i] = made[x, y][1], True, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := made.get((ids[i], ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (m := made.get((ids[before[i]], ids[i]))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], ids[i]))
        return [t for t, g in zip(ids, gone, strict=True) if not g]

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, ids, lengths = [], 0, len(word), self.ids, self.lengths
        while at < n:
            for k in lengths.get(word[at : at + 2], ()):
                if at + k <= n and (part := word[at : at + k]) in ids:
                    break
            else:
                part = word[at : at + 1]
            out.append(ids[part])
            at += len(part)
        return out

    def merged_together(self, words: list[bytes]) -> list[list[int]]:
        """merged() for short words, all in step: a row for each word, its best merge in each round."""
        n, most = len(words), max(map(len, words))
        size = np.fromiter(map(len, words), np.int64, n)
        ids = np.full((n, most + 1), -1, np.int64)
        ids[:, :most][np.arange(most) < size[:, None]] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        rank = self.pair_rank(ids[:, :-1], ids[:, 1:])
        rank[(ids[:, :-1] < 0) | (ids[:, 1:] < 0)] = NEVER
        out: list[list[int]] = [[]] * n
        rows, place = np.arange(n), np.arange(most)
        while len(rows):
            at = rank.argmin(axis=1)
            here = np.arange(len(rows))
            best = rank[here, at]
            over = best == NEVER
            for i, r in zip(np.flatnonzero(over), rows[over], strict=True):
                out[r] = [t for t in ids[i].tolist() if t >= 0]
            go = ~over
            rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
            if not len(rows):
                break
            here = np.arange(len(rows))
            move = place + (place > at[:, None])  # the merged pair's second place goes
            ids[:, :-1] = np.take_along_axis(ids, np.minimum(move, most), 1)
            ids[:, -1] = -1
            rank = np.take_along_axis(np.pad(rank, ((0, 0), (0, 1)), constant_values=NEVER), np.minimum(move, most), 1)
            ids[here, at] = self.rank_id[best]
            for k in (-1, 0):
                i = np.flatnonzero(at + k >= 0)
                x, y = ids[i, at[i] + k], ids[i, at[i] + k + 1]
                rank[i, at[i] + k] = np.where((x >= 0) & (y >= 0), self.pair_rank(x, y), NEVER)
        return out

    def verdicts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """fits() for many pairs; each distinct pair is computed once per worker."""
        keys, back = np.unique(first << 32 | second, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known_keys, keys), max(0, len(self.known_keys) - 1))
        new = self.known_keys[at] != keys if len(self.known_keys) else np.ones(len(keys), bool)
        fit = np.zeros(len(keys), bool)
        if not new.all():
            fit[~new] = self.known_fit[at[~new]]
        if new.any():
            fit[new] = self.fits(keys[new] >> 32, keys[new] & 0xFFFFFFFF)
            if len(self.known_keys) > 2_000_000:
                self.known_keys, self.known_fit = self.known_keys[:0], self.known_fit[:0]
            merged = np.concatenate([self.known_keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.known_keys, self.known_fit = merged[order], np.concatenate([self.known_fit, fit[new]])[order]
        return fit[back]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Speculates on all words, verifies all adjacent pairs at once and merges what fails."""
        out = [self.proposed(w) for w in words]
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        flat = np.fromiter((t for ids in out for t in ids), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(out)), sizes)
        for t in np.unique(flat[self.whole[flat] < 0]):
            self.whole[t] = self.merged(self.bytes[t]) == [t]
        failed = np.zeros(len(out), bool)
        failed[owner[self.whole[flat] == 0]] = True
        if len(flat) > 1:
            inside = owner[1:] == owner[:-1]
            bad = ~self.verdicts(flat[:-1][inside], flat[1:][inside])
            failed[owner[1:][inside][bad]] = True
        short: dict[int, list[int]] = {}
        for i in np.flatnonzero(failed).tolist():
            if len(words[i]) <= 32:
                short.setdefault(len(words[i]) // 4, []).append(i)
            else:
                out[i] = self.merged(words[i])
        for rows in short.values():
            for i, ids in zip(rows, self.merged_together([words[i] for i in rows]), strict=True):
                out[i] = ids
        return out

    def cut_text(self, text: str) -> Iterator[str | int]:
        """A text's words, and the ids of special tokens whose strings stand in it."""
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield self.special[part]
            elif part:
                yield from self.split.findall(part)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        findall, marked = self.split.findall, tuple(self.special)
        cut = [list(self.cut_text(t)) if any(s in t for s in marked) else findall(t) for t in texts]
        known = self.words
        if len(known) > REMEMBERED:
            known.clear()
        known.update((t, np.array([t], "<i4").tobytes()) for t in self.special.values())
        new = [w for w in set().union(*cut) if w not in known]
        known.update(zip(new, (array("i", ids).tobytes() for ids in self.encode_words([w.encode() for w in new])), strict=True))
        parts = [b"".join(map(known.__getitem__, ws)) for ws in cut]
        for w in new:
            if len(w) > REMEMBERED_CHARS:
                del known[w]
        return np.frombuffer(b"".join(parts), "<i4"), np.fromiter((len(p) >> 2 for p in parts), np.int64, len(parts))


    def decode(self, column: pa.Array) -> list[str]:
        """The texts of a column of id lists: the tokens' bytes are gathered for all lists at once."""
        flat, rows = column.flatten(), pc.coalesce(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        gone = np.asarray(flat.is_null())
        t = np.asarray(flat.fill_null(0)).astype(np.int64)
        n = np.where(gone, 0, self.spelled_n[t])
        ends = np.cumsum(n)
        spelled = self.spelled[np.repeat(self.spelled_at[t] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(rows)])].tolist()
        return [spelled[a:b].decode("utf-8", "replace") for a, b in zip(stops[:-1], stops[1:], strict=True)]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column `ids` (array of int): the whole text's tokens. A column of that name is replaced.

    vocabulary_path must name the file on every machine; it is public and comes with the Python environment.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        v.words.clear()  # a worker is used again by other tasks; what it remembers is for one task
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for first, end in K.pieces(K.text_buffer(column)[1]):
                flat, counts = v.encode([t or "" for t in column.slice(first, end - first).to_pylist()])
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, K.list_array(flat, counts, pa.int32())], names=[*batch.schema.names, ids])
        v.words.clear()

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with a column `text`: what its ids stand for, special tokens included; bytes that are no UTF-8
    become U+FFFD. Null ids give an empty text, null within ids is skipped."""
    bounded_batches(df.sparkSession)
    df = df.drop(text)
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(vocabulary_path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            for row in range(0, len(column), 500):
                texts = v.decode(column.slice(row, 500))
                yield pa.RecordBatch.from_arrays([*batch.slice(row, 500).columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text])

    return df.mapInArrow(run, schema)


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = only(table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    encoded = encode(docs, path).select("doc_id", "ids")
    return decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
