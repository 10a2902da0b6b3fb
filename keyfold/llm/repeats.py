"""Repeated windows over all documents: the blocks that operators 9 and 10 work in.

A document is a row of symbols (bytes or words). Which windows of `length` symbols stand elsewhere too is
found without ever bringing all windows together:

* Each window is put under its anchor: of the grams of `gram` symbols within the window the one with the
  least hash, the leftmost of equals. Equal windows have equal anchors. Neighbouring windows mostly share an
  anchor, so a document has about 2 anchors for each length - gram + 1 symbols. The windows of one anchor make a
  context, and all contexts of one anchor are a block.
* A block with very many different contexts is split: a context's windows are cut into PARTS by their distance
  from the anchor. All windows of a part hold the part's core, the symbols they have in common, and
  equal windows have equal cores, so the parts with one core are a block by themselves. This goes on until a
  block isn't wide any more; at last it holds a single window's copies. Which blocks are wide is told by a
  sample of documents, and decides on the way only: results are the same whatever the sample says.
* Equal contexts of a block are one entry of it, that stands for its first place (so no copies, however
  many, are compared). The other places repeat the whole context. Equal contexts within a piece of input, and in
  frequent blocks those of a task, are reduced to one before anything is shuffled.
* Blocks with several entries get the bytes of these, and a method (see suffix and lempel) compares
  them there, symbol by symbol.

A block goes to one task. It holds at most about SHARE of all contexts, or HOT * SAMPLE where that is more, as
wider ones are split; so at most 1 / SHARE blocks of the sample are broadcast as wide or frequent.

Documents are told apart and ordered by (doc_id, hash of the text): rows equal in both are one document,
whose result holds for each of them. A null doc_id is before all others. Null text is as empty. Very long
documents are worked on in stretches of STRETCH symbols. Contexts are taken for equal by two 64-bit hashes, of
the anchor and of the whole context; windows of different contexts by their symbols.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm import kernels as K
from keyfold.llm.common import bounded_batches, forget, shuffle_width, written
from keyfold.llm.suffixes import Order, ordered

#: One document in SAMPLE tells which blocks are wide (HOT different contexts there, SHARE of all at least) or frequent.
SAMPLE, HOT, SHARE = 64, 32, 1e-7
#: Parts that a wide block's windows are cut into.
PARTS = 4
#: Rows that a reducing task looks at together, but for blocks that have more; bytes of contexts that are compared together.
ROWS, TOGETHER = 200_000, 1 << 20
STRETCH = 1 << 20
FIRST_ID = -(1 << 63)


@dataclass(frozen=True)
class Unit:
    """What a symbol is.

    symbols(buf, offs) gives the symbols and the documents' offsets in them, values(symbols) a 64-bit hash of each,
    places(buf, offs) where in buf each symbol begins and ends (None: symbols are bytes), strings(buf, offs)
    comparable symbols of contexts, of which any number may stand between them, and where each context's begin
    and how many they are."""

    length: int
    gram: int
    keep_first: bool
    base: int
    reach: int
    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    values: Callable[[np.ndarray], np.ndarray]
    places: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None
    strings: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def keyed_columns(doc_id: str, text: str) -> list[Column]:
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return [F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(FIRST_ID)).alias("d"), F.xxhash64(t).alias("k"), t.alias("text")]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(d, k, text): the document's key and its text."""
    return docs.select(keyed_columns(doc_id, text))


def documents(batch: pa.RecordBatch, text: int = 2) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, end row, buf, offs) of pieces of a batch."""
    buf, offs = K.text_buffer(batch.column(text))
    for first, end in K.pieces(offs):
        yield first, end, buf[offs[first] : offs[end]], offs[first : end + 1] - offs[first]


def within(h: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each hash is among some, which are sorted as signed numbers."""
    if not len(some):
        return np.zeros(len(h), bool)
    x = h.view(np.int64)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


@dataclass
class Contexts:
    """Contexts: block, hash, document key, first and last window start (symbols of the document)."""

    h: np.ndarray
    c: np.ndarray
    d: np.ndarray
    k: np.ndarray
    a: np.ndarray
    b: np.ndarray

    def take(self, at: np.ndarray) -> Contexts:
        return Contexts(*(x[at] for x in self.columns()))

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.h, self.c, self.d, self.k, self.a, self.b

    @staticmethod
    def joined(parts: list[Contexts]) -> Contexts:
        return Contexts(*(np.concatenate(x) for x in zip(*(p.columns() for p in parts), strict=True)))


def anchored(values: np.ndarray, offs: np.ndarray, unit: Unit, wide: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, block, context, first, last) of all contexts, wide blocks split."""
    n, span, w = len(values), unit.length, unit.length - unit.gram + 1
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2)
    long = np.flatnonzero(np.diff(offs) >= span)
    if not len(long):
        return none
    sums, inverse = K.prefix(values), K.powers(n + 1)[1]
    g = (sums[unit.gram :] - sums[: -unit.gram]) * inverse[: n - unit.gram + 1]
    g ^= g >> np.uint64(32)
    g *= np.uint64(0x9FB21C651E98DF25)
    bits = np.uint64(int(n).bit_length())
    least = (g >> bits << bits) | np.arange(len(g), dtype=np.uint64)
    have = 1
    while 2 * have <= w:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < w:
        least = np.minimum(least[: len(least) - (w - have)], least[w - have :])
    valid = np.zeros(n - span + 2, np.int64)
    valid[offs[:-1][long]] += 1
    np.subtract.at(valid, offs[1:][long] - span + 1, 1)
    starts = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    at = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.searchsorted(offs, starts, side="right") - 1
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    first, last, at = starts[new], starts[np.r_[new[1:], len(starts)] - 1], at[new]
    doc, h, first, last = split(doc[new], K.mix(g[at]), at, first, last, sums, unit, wide)
    return doc, h, K.spans_hash(sums, first, last + span), first, last


def split(doc: np.ndarray, h: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, sums: np.ndarray, unit: Unit, wide: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, block, first, last) with contexts of wide blocks cut into parts, and those again. `at` is where
    the anchor stands; a part holds the windows whose distance from it is in [low, high)."""
    low, high = np.zeros(len(h), np.int64), np.full(len(h), unit.length - unit.gram + 1)
    done = []
    while True:
        cut = within(h, wide) & (high - low > 1)
        done.append([x[~cut] for x in (doc, h, first, last)])
        if not cut.any():
            break
        rows = [x[cut] for x in (doc, h, at, first, last, low, high)]
        step, parts = -(-(rows[6] - rows[5]) // PARTS), []
        for part in range(PARTS):
            doc, h, at, first, last, low, high = rows
            low = low + part * step
            high = np.minimum(low + step, high)
            first, last = np.maximum(first, at - high + 1), np.minimum(last, at - low)
            some = np.flatnonzero((low < high) & (first <= last))
            doc, h, at, first, last, low, high = (x[some] for x in (doc, h, at, first, last, low, high))
            core = K.spans_hash(sums, at - low, at - high + 1 + unit.length)
            tag = K.mix(core + low.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + high.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
            parts.append((doc, K.mix(h ^ tag), at, first, last, low, high))
        doc, h, at, first, last, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def contexts_of(d: np.ndarray, k: np.ndarray, buf: np.ndarray, offs: np.ndarray, unit: Unit, wide: np.ndarray) -> Iterator[Contexts]:
    """The contexts of a piece of documents; those of a long document in stretches."""
    symbols, starts = unit.symbols(buf, offs)
    step = STRETCH if len(d) == 1 else max(len(symbols), 1)
    for s in range(0, len(symbols), step):
        some = symbols[s : s + step + unit.length - 1]
        inside = np.array([0, len(some)]) if len(d) == 1 else starts
        doc, h, c, first, last = anchored(unit.values(some), inside, unit, wide)
        shift = s - starts[doc]
        yield Contexts(h, c, d[doc], k[doc], first + shift, last + shift)


def paired(h: np.ndarray) -> np.ndarray:
    """Which of sorted hashes have an equal neighbour."""
    out = np.zeros(len(h), bool)
    out[1:] = h[1:] == h[:-1]
    out[:-1] |= out[1:]
    return out


def classes(x: Contexts, keep_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(leads, repeated): the first place of each (block, context), and the places that equal contexts elsewhere make
    repeated, without the first if it is to be kept. Rows that are one place are no repeats of each other."""
    order = np.argsort(x.h)
    same = paired(x.h[order])
    single, some = order[~same], order[same]
    if not len(some):
        return single, some
    some = some[np.lexsort((x.a[some], x.k[some], x.d[some], x.c[some], x.h[some]))]
    h, c, d, k, a = (y[some] for y in (x.h, x.c, x.d, x.k, x.a))
    lead = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
    at, of = np.flatnonzero(lead), np.cumsum(lead) - 1
    other = (d != d[at][of]) | (k != k[at][of]) | (a != a[at][of])
    several = np.logical_or.reduceat(other, at)[of]
    return np.r_[single, some[lead]], some[several & (other if keep_first else (other | lead))]


def packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a << np.int64(32) | b


def record(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x) for x in columns], names=names.split())


def hot_blocks(docs: DataFrame, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of frequent and of wide blocks, at most 1 / SHARE of each, from a sample of documents."""
    some = written(docs.where(F.pmod(F.xxhash64("d", "k"), F.lit(SAMPLE)) == 0), "sample")
    wide, least = np.zeros(0, np.int64), None
    while True:

        def run(batches: Iterable[pa.RecordBatch], wide: np.ndarray = wide) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d, k = (np.asarray(batch.column(i)) for i in range(2))
                for first, end, buf, offs in documents(batch):
                    for x in contexts_of(d[first:end], k[first:end], buf, offs, unit, wide):
                        x = x.take(classes(x, True)[0])
                        yield record("h c", x.h, x.c)

        rows = some.mapInArrow(run, "h bigint, c bigint").groupBy("h", "c").agg(F.count("*").alias("n"))
        blocks = written(rows.groupBy("h").agg(F.sum("n").alias("n"), F.count("*").alias("m")).where(F.col("n") >= F.lit(HOT)), "blocks")
        if least is None:  # all contexts of the sample are at most as many as its symbols
            least = max(HOT, SHARE * (some.agg(F.sum(F.length("text"))).first()[0] or 0))
        found = blocks.where(F.col("n") >= F.lit(least)).collect()
        forget(blocks)
        frequent = np.sort(np.array([r.h for r in found], np.int64))
        new = np.setdiff1d(np.array([r.h for r in found if r.m >= least], np.int64), wide)
        if not len(new):
            forget(some)
            return frequent, wide
        wide = np.union1d(wide, new)


def emitted(docs: DataFrame, unit: Unit, hot) -> DataFrame:
    """(kind, h, c, d, k, ab): kind 1 are contexts that equal ones make repeated already (h only spreads them), kind 2
    the first of each class of equal contexts in each piece, or task in frequent blocks."""
    schema = "kind int, h bigint, c bigint, d bigint, k bigint, ab bigint"

    def rows(kind: int, x: Contexts) -> pa.RecordBatch:
        h, c = (x.h, x.c) if kind == 2 else (K.mix(x.k.view(np.uint64) + x.a.astype(np.uint64)), np.zeros(len(x.h), np.uint64))
        return record("kind h c d k ab", np.full(len(h), kind, np.int32), h, c, x.d, x.k, packed(x.a, x.b))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, wide = hot.value
        held: list[Contexts] = []
        size, room = 0, ROWS

        def reduced() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            x = Contexts.joined(held)
            lead, repeated = classes(x, unit.keep_first)
            yield rows(1, x.take(repeated))
            held, size = [x.take(lead)], len(lead)

        for batch in batches:
            d, k = (np.asarray(batch.column(i)) for i in range(2))
            for first, end, buf, offs in documents(batch):
                for x in contexts_of(d[first:end], k[first:end], buf, offs, unit, wide):
                    lead, repeated = classes(x, unit.keep_first)
                    if len(repeated):
                        yield rows(1, x.take(repeated))
                    often = within(x.h[lead], frequent)
                    yield rows(2, x.take(lead[~often]))
                    if often.any():
                        held.append(x.take(lead[often]))
                        size += int(often.sum())
                        if size >= room:
                            yield from reduced()
                            if size >= ROWS // 2:  # little is equal: don't hold on to it
                                yield rows(2, held[0])
                                held, size = [], 0
        if held:
            yield from reduced()
            yield rows(2, held[0])

    return docs.mapInArrow(run, schema)


def by_block(batches: Iterable[pa.RecordBatch], key: int = 0) -> Iterator[pa.RecordBatch]:
    """Batches, sorted by the key column, joined so that each holds whole keys and about ROWS rows."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= ROWS:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            h = np.asarray(whole.column(key))
            cut = int(np.searchsorted(h, h[-1], side="left"))
            if cut:
                yield whole.slice(0, cut)
            held, size = [whole.slice(cut)], whole.num_rows - cut
            if not cut:
                size = 0  # one key only: look again after ROWS more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def judged(rows: DataFrame, unit: Unit, partitions: int) -> DataFrame:
    """(kind, h, d, k, ab) of emitted(): kind 1 are contexts that equal ones make repeated, kind 2 the first of each
    class in blocks with several classes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_block(batches, 1):
            kind, h, c, d, k, ab = (np.asarray(batch.column(i)) for i in range(6))
            known = np.flatnonzero(kind == 1)
            yield record("kind h d k ab", np.ones(len(known), np.int32), h[known], d[known], k[known], ab[known])
            at = np.flatnonzero(kind == 2)
            at = at[paired(h[at])]
            x = Contexts(np.asarray(batch.column(1))[at].view(np.uint64), c[at].view(np.uint64), d[at], k[at], ab[at] >> 32, ab[at] & 0xFFFFFFFF)
            lead, repeated = classes(x, unit.keep_first)
            lead = lead[np.argsort(x.h[lead])]
            several = paired(x.h[lead])
            both = np.r_[repeated, lead[several]]
            yield record("kind h d k ab", np.r_[np.ones(len(repeated), np.int32), np.full(int(several.sum()), 2, np.int32)], x.h[both], x.d[both], x.k[both], packed(x.a[both], x.b[both]))

    dealt = rows.repartition(partitions, "h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "kind int, h bigint, d bigint, k bigint, ab bigint")


def with_bytes(entries: DataFrame, docs: DataFrame, unit: Unit) -> DataFrame:
    """(h, d, k, ab, bytes): each context's bytes, taken from the texts."""
    lists = entries.groupBy("d", "k").agg(F.collect_list(F.struct("h", "ab")).alias("wanted"))
    joined = docs.join(lists, ["d", "k"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, k = (np.asarray(batch.column(i)) for i in range(2))
            wanted = batch.column(3)
            for first, end, buf, offs in documents(batch):
                part = wanted.slice(first, end - first)
                h, ab = np.asarray(part.flatten().field("h")), np.asarray(part.flatten().field("ab"))
                doc = np.repeat(np.arange(end - first), np.asarray(part.value_lengths()))
                a, b = ab >> 32, (ab & 0xFFFFFFFF) + unit.length
                if unit.places is None:
                    lo, hi = offs[doc] + a, offs[doc] + b
                else:
                    begins, ends, own = unit.places(buf, offs)
                    before = np.searchsorted(own, doc)
                    lo, hi = begins[before + a], ends[before + b - 1]
                size = hi - lo
                cuts = np.searchsorted(np.cumsum(size), np.arange(TOGETHER, int(size.sum()) + TOGETHER, TOGETHER))
                for x, y in zip(np.r_[0, cuts], np.r_[cuts, len(size)], strict=True):
                    if x == y:
                        continue
                    n = size[x:y]
                    ends_at = np.cumsum(n)
                    body = buf[np.repeat(lo[x:y] - (ends_at - n), n) + np.arange(ends_at[-1])]
                    payload = pa.BinaryArray.from_buffers(pa.binary(), y - x, [None, pa.py_buffer(np.r_[0, ends_at].astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
                    own_rows = doc[x:y] + first
                    yield pa.RecordBatch.from_arrays([pa.array(h[x:y]), pa.array(d[own_rows]), pa.array(k[own_rows]), pa.array(ab[x:y]), payload], names=["h", "d", "k", "ab", "bytes"])

    return joined.select("d", "k", "text", "wanted").mapInArrow(run, "h bigint, d bigint, k bigint, ab bigint, bytes binary")


#: method(suffixes in order, first suffix and number of suffixes of each context) says which windows are to go.
Method = Callable[[Order, np.ndarray, np.ndarray], np.ndarray]


def suffix_order(batch: pa.RecordBatch, unit: Unit) -> tuple[Order, np.ndarray, np.ndarray, np.ndarray]:
    """(order, first suffix of each context, windows of each, rows of the batch the contexts are): whole blocks
    in suffix order. Suffixes are numbered by position: contexts by block and place, windows within."""
    h, d, k, ab = (np.asarray(batch.column(i)) for i in range(4))
    place = np.lexsort((ab, k, d, h))
    again = np.zeros(len(place), bool)  # rows that are one document bring a context twice
    again[1:] = np.logical_and.reduce([x[place][1:] == x[place][:-1] for x in (h, d, k, ab)])
    place = place[~again]
    windows = ((ab & 0xFFFFFFFF) - (ab >> 32) + 1)[place]
    body, offs = K.text_buffer(batch.column(4))
    symbols, begin, size = unit.strings(body, offs)
    block = np.cumsum(np.r_[False, h[place][1:] != h[place][:-1]])
    owner = np.repeat(np.arange(len(place)), windows)
    first = np.cumsum(windows) - windows
    inside = np.arange(len(owner)) - first[owner]
    key = symbols.astype(np.uint64)
    if unit.base > 1:
        key, wide = np.zeros(len(symbols), np.uint64), np.r_[symbols, np.zeros(unit.base, symbols.dtype)].astype(np.uint64)
        for i in range(unit.base):
            key |= wide[i : i + len(symbols)] << np.uint64(8 * (unit.base - 1 - i))
    order = ordered(symbols, key, unit.base, unit.reach, begin[place][owner] + inside, size[place][owner] - inside, block[owner])
    return order, first, windows, place


def compared(ctx: DataFrame, unit: Unit, partitions: int, method: Method) -> DataFrame:
    """(d, k, ab): runs of windows that the method finds repeated in their block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in by_block(batches):
            h = np.asarray(whole.column(0))
            ends = np.flatnonzero(np.r_[h[1:] != h[:-1], True]) + 1
            offs = K.text_buffer(whole.column(4))[1]
            row = 0
            while row < len(h):  # whole blocks of about TOGETHER bytes
                fits = np.searchsorted(offs, offs[row] + TOGETHER, side="right") - 1
                stop = int(ends[max(np.searchsorted(ends, fits, side="right") - 1, np.searchsorted(ends, row, side="right"))])
                batch = whole.slice(row, stop - row)
                row = stop
                order, first, windows, place = suffix_order(batch, unit)
                gone = method(order, first, windows)
                d, k, ab = (np.asarray(batch.column(i))[place] for i in range(1, 4))
                owner = np.repeat(np.arange(len(place)), windows)
                i = np.flatnonzero(gone)
                o = owner[i]
                start = i - first[o] + (ab[o] >> 32)
                new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (start[1:] != start[:-1] + 1)]) if len(i) else i
                end = np.r_[new[1:], len(i)] - 1 if len(i) else i
                yield record("d k ab", d[o[new]], k[o[new]], packed(start[new], start[end]))

    dealt = ctx.repartition(partitions, "h").sortWithinPartitions("h")
    return dealt.mapInArrow(run, "d bigint, k bigint, ab bigint")


def repeated_spans(docs: DataFrame, unit: Unit, method: Method) -> DataFrame:
    """(d, k, spans) of each document that has repeated windows; a span packs its first and last window start.

    docs is as keyed() makes it. In which blocks windows are compared is said at the module's head.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    hot = spark.sparkContext.broadcast(hot_blocks(docs, unit))
    n = shuffle_width(docs)
    rows = judged(emitted(docs, unit, hot), unit, n)
    known = rows.where("kind = 1").select("d", "k", "ab")
    found = compared(with_bytes(rows.where("kind = 2"), docs, unit), unit, n, method)
    return known.unionByName(found).groupBy("d", "k").agg(F.collect_list("ab").alias("spans"))


def covered(spans: pa.Array, offs: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, begin, end) of the maximal runs of symbols that the spans of a piece's documents cover, in order; offs are
    the documents' symbol offsets, and runs are within the whole piece."""
    ab = np.asarray(spans.flatten())
    n = np.asarray(spans.value_lengths().fill_null(0)).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    begin, end = offs[doc] + (ab >> 32), offs[doc] + (ab & 0xFFFFFFFF) + unit.length
    order = np.argsort(begin, kind="stable")
    doc, begin, end = doc[order], begin[order], np.maximum.accumulate(end[order]) if len(order) else end
    new = np.r_[True, (begin[1:] > end[:-1]) | (doc[1:] != doc[:-1])] if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return doc[at], begin[at], end[np.r_[at[1:], len(order)] - 1] if len(at) else at


def marked(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n places disjoint runs cover."""
    edge = np.zeros(n + 1, np.int8)
    np.add.at(edge, begin, 1)
    np.subtract.at(edge, end, 1)
    return np.cumsum(edge[:n], dtype=np.int8) > 0


def original_id() -> Column:
    return F.when(F.col("d") != FIRST_ID, F.col("d")).alias("doc_id")
