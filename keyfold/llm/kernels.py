"""Vectorised text kernels for Arrow batches: words, 64-bit word and window hashes.

All of them take one contiguous UTF-8 buffer and the offsets of its documents, so that
numpy does the per-byte work and no Python loop runs over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes of text that are worked on at a time; a longer document is a piece of its own.
PIECE = 1 << 20
#: The same for work that makes many arrays of a piece: Python workers keep about what they once needed.
SMALL = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (that of SplitMix64): spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, PIECE + 1), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null is as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    if column.null_count:
        length = np.where(np.asarray(column.is_null()), 0, np.diff(offs))
        if int(length.sum()) != len(buf):  # a null that has bytes
            buf = buf[np.repeat(np.asarray(column.is_valid()), np.diff(offs))]
        offs = np.concatenate([[0], np.cumsum(length)])
    return buf, offs


def pieces(offs: np.ndarray, most: int = PIECE):
    """Ranges (first, end) of whole documents with at most `most` bytes each, or one longer document."""
    first, n = 0, len(offs) - 1
    while first < n:
        end = int(np.searchsorted(offs, offs[first] + most, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end
        first = end


def prefix(values: np.ndarray) -> np.ndarray:
    """Sums of values[i] * base**i before each place, modulo 2**64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def spans_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each [start, end) from prefix(); equal contents have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def byte_sums(buf: np.ndarray) -> np.ndarray:
    return prefix(_BYTE[buf])


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word; a word never crosses documents."""
    if len(buf) == 0:
        return (np.zeros(0, np.int64),) * 3
    solid = ~SPACE[buf]
    full = offs[:-1][offs[:-1] < offs[1:]]
    last = offs[1:][offs[:-1] < offs[1:]] - 1
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    closes[:-1] &= ~solid[1:]
    opens[full] = solid[full]
    closes[last] = solid[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def words(buf: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, start, end) of every word; lower folds A-Z first. A long text is hashed in stretches."""
    starts, ends, doc = word_spans(buf, offs)
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(starts):
        at = starts[first]
        end = max(first + 1, int(np.searchsorted(ends, at + 2 * PIECE, side="right")))
        some = buf[at : ends[end - 1]]
        out[first:end] = spans_hash(byte_sums(LOWER[some] if lower else some), starts[first:end] - at, ends[first:end] - at)
        first = end
    return out, doc, starts, ends


_ORDER = np.random.default_rng(20240301).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, at the run's first word; documents are not looked at."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += hashes[k : k + m] * _ORDER[k]
    return mix(out)


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    if offsets[-1] >= 1 << 31:
        raise ValueError("a batch of lists is over 2 GB; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, type=kind))
