"""Operator 2: MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets form classes first (one grouped aggregation), and only one document of
each class goes on. Bands of its MinHash signature make candidates; a candidate pair's signatures are
compared batch by batch, and the pair is dropped as soon as the posterior probability that its similarity
reaches the threshold is below MISS; the survivors' whole shingle sets are compared exactly.

A bucket of a band is never spread into all its pairs. Its members are compared with the bucket's hub, the
member that shares the most buckets with others; links make components, and pairs within one component
need no comparison any more. What is left are pairs of a bucket whose components differ. Documents that have
too few shingles in common with all the others of these together drop out, and of buckets with the same members
one is enough. The rest are compared by tiles: two blocks of one bucket, of about BLOCK documents or
BLOCK_SHINGLES shingles at most, whose overlaps are a matrix product of their shingle sets, and of whose links a tile
returns only as many as join its components. So no link between components of a bucket is lost, and the
links made grow with the documents, not with pairs. Documents of one bucket that are all near each other, but not
near enough, do cost comparisons with the square of their number, and each is sent to as many tiles as
its bucket has blocks: that all of them are no links can't be told otherwise.

The number of bands follows from the threshold: a pair at the threshold shares no bucket with probability below
MISS (24 bands of 5 rows at 85 percent, 35 at 80).

Null and empty texts have empty sets and are linked with nothing, as are rows with a null doc_id, which
are kept and have a null component. Rows with one doc_id are one node that has the links of all of them;
rows of equal text are in one class. Links of exact copies hold whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import kernels as K
from keyfold.llm.common import bounded_batches, forget, table, written
from keyfold.llm.components import components

#: Signature values compared at a time, and the probability with which a pair at the threshold may share no bucket,
#: or be given up by its posterior.
BATCH, MISS = 24, 1e-6
#: Signature values at most, if a band can have more than one row.
SIGNATURE = 256
#: Documents and shingles of a tile's block.
BLOCK, BLOCK_SHINGLES = 1000, 1 << 20


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows of each) for a threshold: as many rows, up to 5, as SIGNATURE allows."""
    t = percent / 100
    for rows in (5, 4, 3, 2, 1):
        bands = ceil(log(MISS) / log(1 - t**rows)) if t < 1 else 1
        if bands * rows <= SIGNATURE or rows == 1:
            return bands, rows
    raise AssertionError


def permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and addends of n hash functions of 32 bits."""
    rng = np.random.default_rng(20240311)
    x = rng.integers(0, 1 << 32, (n, 2), dtype=np.uint64).astype(np.uint32)
    return x[:, 0] | np.uint32(1), x[:, 1]


def shingles(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct shingles of each document, in order of both; fewer words than
    size: all of them as one."""
    h, doc, _, _ = K.words(buf, offs, lower=True)
    n = np.bincount(doc, minlength=len(offs) - 1)
    g = K.grams(h, size)
    whole = doc[: len(g)] == doc[size - 1 :] if len(g) else np.zeros(0, bool)
    gs, ds = [g[whole]], [doc[: len(g)][whole]]
    first = np.cumsum(n) - n
    for few in range(1, size):
        at = np.flatnonzero(n == few)
        if len(at):
            gs.append(K.mix(sum(h[first[at] + k] * K._ORDER[k] for k in range(few))))
            ds.append(at)
    g, d = np.concatenate(gs), np.concatenate(ds)
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
    return g[new], d[new]


def sketch(docs: DataFrame, size: int, bands_of: int, rows_of: int) -> DataFrame:
    """(doc_id, n_shingles, c1, c2, bands, signature) of every row of docs (doc_id, text); c1 and c2 are a
    digest of the set; bands and signature are null for empty sets."""
    bounded_batches(docs.sparkSession)
    values = bands_of * rows_of
    factor, addend = permutations(values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.text_buffer(batch.column(1))
            for first, end in K.pieces(offs, K.SMALL):
                part = buf[offs[first] : offs[end]]
                g, d = shingles(part, offs[first : end + 1] - offs[first], size)
                n = np.bincount(d, minlength=end - first)
                has = np.flatnonzero(n)
                start = (np.cumsum(n) - n)[has]
                c1, c2 = np.zeros(end - first, np.uint64), np.zeros(end - first, np.uint64)
                signature = np.zeros((len(has), values), np.uint32)
                bands = np.zeros((len(has), bands_of), np.uint64)
                if len(has):
                    c1[has], c2[has] = np.add.reduceat(K.mix(g), start), np.add.reduceat(K.mix(g ^ np.uint64(0x5851F42D4C957F2D)), start)
                    x = (g >> np.uint64(32)).astype(np.uint32)
                    for k in range(values):
                        signature[:, k] = np.minimum.reduceat(x * factor[k] + addend[k], start)
                    wide = signature.astype(np.uint64).reshape(len(has), bands_of, rows_of)
                    bands = K.mix((wide * K._ORDER[:rows_of]).sum(axis=2, dtype=np.uint64) + np.arange(bands_of, dtype=np.uint64) * K._ORDER[rows_of])
                empty = np.ones(end - first, bool)
                empty[has] = False
                raw = iter(signature)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, end - first),
                        pa.array(n.astype(np.int64)),
                        pa.array(c1.view(np.int64)),
                        pa.array(c2.view(np.int64)),
                        K.list_array(bands.view(np.int64).ravel(), np.where(empty, 0, bands_of), pa.int64()),
                        pa.array([None if e else next(raw).tobytes() for e in empty], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "c1", "c2", "bands", "signature"],
                )

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, c1 bigint, c2 bigint, bands array<bigint>, signature binary")


def fewest(threshold: float, values: int) -> list[tuple[int, int]]:
    """(values compared, least matches to go on): below, the posterior of similarity >= threshold under a
    flat prior, which is a binomial tail, is less than MISS."""
    out = []
    for n in range(BATCH, values + 1, BATCH):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= MISS:
                break
            m += 1
        out.append((n, m))
    return out


def surviving(pairs: DataFrame, nodes: DataFrame, percent: int, values: int) -> DataFrame:
    """The (a, b) of pairs that sequential comparison of the signatures doesn't give up."""
    one = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("signature").alias(f"s_{c}"))
    both = pairs.join(one("b"), "b").join(one("a"), "a")
    near = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    steps = fewest(percent / 100, values)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, values) for c in (2, 3))
            at, matches, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
            for n, least in steps:
                matches[at] += (x[at, done:n] == y[at, done:n]).sum(axis=1)
                at, done = at[matches[at] >= least], n
            yield batch.take(pa.array(at)).select(["a", "b"])

    return both.where(near).select("a", "b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, linked) by whole shingle sets."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("t_a")), "a")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (u, ou), (v, ov) = K.text_buffer(batch.column(2)), K.text_buffer(batch.column(3))
            linked = np.zeros(batch.num_rows, bool)
            for first, end in K.pieces(ou + ov, K.SMALL):
                (g, d), (h, e) = (shingles(t[o[first] : o[end]], o[first : end + 1] - o[first], size) for t, o in ((u, ou), (v, ov)))
                all_d, all_g = np.concatenate([d, e]), np.concatenate([g, h])
                order = np.lexsort((all_g, all_d))
                sd, sg = all_d[order], all_g[order]
                same = (sd[1:] == sd[:-1]) & (sg[1:] == sg[:-1])
                m = end - first
                shared = np.bincount(sd[1:][same], minlength=m)
                either = np.bincount(all_d, minlength=m) - shared
                linked[first:end] = 100 * shared >= percent * either
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked)], names=["a", "b", "linked"])

    return both.select("a", "b", "t_a", "t_b").mapInArrow(run, "a bigint, b bigint, linked boolean")


def shared_shingles(texts: DataFrame, rows: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, n_shingles, most) of the nodes in rows: most is the number of their shingles that another one of
    them has as well (all, for a node of several texts)."""
    some = texts.join(rows.select("node").distinct(), "node", "left_semi").select("node", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.text_buffer(batch.column(1))
            node = np.asarray(batch.column(0))
            for first, end in K.pieces(offs, K.SMALL):
                g, d = shingles(buf[offs[first] : offs[end]], offs[first : end + 1] - offs[first], size)
                yield pa.RecordBatch.from_arrays([pa.array(node[first:end][d]), pa.array(g.view(np.int64))], names=["node", "g"])

    single = some.mapInArrow(run, "node bigint, g bigint").groupBy("g").agg(F.min("node").alias("node"), F.max("node").alias("other")).where(F.col("node") == F.col("other"))
    alone = single.groupBy("node").agg(F.count("*").alias("u"))
    sizes = nodes.join(some.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.max("n_shingles").alias("n_shingles"), F.count("*").alias("texts"))
    u = F.when(F.col("texts") == 1, F.coalesce("u", F.lit(0))).otherwise(0)
    return sizes.join(alone, "node", "left").select("node", "n_shingles", (F.col("n_shingles") - u).alias("most"))


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indexes of the pairs (a, b) that join what wasn't joined by those before."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := top.setdefault(x, x)) != x:
            top[x] = x = top[y]
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        if (x := find(x)) != (y := find(y)):
            top[max(x, y)] = min(x, y)
            out.append(i)
    return out


def tiled_links(rows: DataFrame, texts: DataFrame, nodes: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): links between components c among rows (band, node, c), enough to join all that are linked."""
    able = shared_shingles(texts, rows, nodes, size).where((100 + percent) * F.col("most") >= percent * (F.col("n_shingles") + F.ceil(F.col("n_shingles") * percent / 100))).select("node", "n_shingles")
    rest = written(rows.join(able, "node"), "open")
    mark = F.xxhash64("node")
    same = [F.count("*").alias("n"), F.sum("n_shingles").alias("w"), F.bit_xor(mark).alias("x"), F.sum(F.pmod(mark, F.lit(1 << 31))).alias("y")]
    buckets = rest.groupBy("band").agg(*same).where("n > 1").groupBy("n", "w", "x", "y").agg(F.min("band").alias("band"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES))
    tiles = rest.join(buckets.select("band", blocks.alias("blocks")), "band")
    tiles = tiles.withColumn("i", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    tiles = tiles.select("band", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), F.col("i").alias("own"), "node", "c")

    def run(tile: pa.Table) -> pa.Table:
        x, y = tile["x"][0].as_py(), tile["y"][0].as_py()
        own, node, c = (np.asarray(tile[n].combine_chunks()) for n in ("own", "node", "c"))
        buf, offs = K.text_buffer(tile["text"].combine_chunks())
        parts = [(g, d + first) for first, end in K.pieces(offs, K.SMALL) for g, d in [shingles(buf[offs[first] : offs[end]], offs[first : end + 1] - offs[first], size)]]
        g, d = (np.concatenate(p) for p in zip(*parts, strict=True))
        n = np.bincount(d, minlength=len(own))
        _, at, times = np.unique(g, return_inverse=True, return_counts=True)
        d, at = d[times[at] > 1], at[times[at] > 1]
        column = np.cumsum(times > 1) - 1
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        shared = np.zeros((len(left), len(right)), np.float32)
        at = column[at]
        order = np.argsort(at, kind="stable")
        d, at = d[order], at[order]
        for first in range(0, int(at[-1]) + 1 if len(at) else 0, 2048):
            lo, hi = np.searchsorted(at, [first, first + 2048])
            sets = np.zeros((len(own), 2048), np.float32)
            sets[d[lo:hi], at[lo:hi] - first] = 1
            shared += sets[left] @ sets[right].T
        either = n[left][:, None] + n[right][None, :] - shared
        p, q = np.nonzero((100 * shared >= percent * either) & (c[left][:, None] != c[right][None, :]))
        p, q = left[p], right[q]
        _, once = np.unique(np.stack([np.minimum(c[p], c[q]), np.maximum(c[p], c[q])]), axis=1, return_index=True)
        p, q = p[once], q[once]
        keep = forest(c[p], c[q])
        return pa.table({"a": pa.array(node[p[keep]]), "b": pa.array(node[q[keep]])})

    return tiles.join(texts.select("node", "text"), "node").groupBy("band", "x", "y").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of `size`-word shingles.
    component_id is the smallest doc_id reachable, kept says that it is the row's own.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    bands_of, rows_of = banding(percent)
    sketches = written(sketch(rows, size, bands_of, rows_of), "sketch")
    full = sketches.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    classes = full.groupBy("c1", "c2", "n_shingles").agg(F.min("doc_id").alias("node"))
    # one row of each class stands for it; equal sets have equal bands and signatures
    first = full.join(classes, ["c1", "c2", "n_shingles"])
    members = written(first.select("doc_id", "node", "c1", "c2", "n_shingles"), "members")
    nodes = written(full.join(members.where(F.col("doc_id") == F.col("node")), ["doc_id", "c1", "c2", "n_shingles"]).dropDuplicates(["doc_id", "c1", "c2"]).select("node", "c1", "n_shingles", "bands", "signature"), "nodes")
    texts = rows.where(F.col("doc_id").isNotNull()).withColumnRenamed("doc_id", "node")
    bands = nodes.select("node", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    buckets = written(bands.join(shared, "band"), "buckets")  # members of buckets with company
    degrees = written(buckets.groupBy("node").agg(F.sum("n").alias("degree")), "degrees")
    candidates = written(texts.join(degrees, "node", "left_semi"), "candidates")
    members_of = written(buckets.join(degrees, "node").select("band", "node", "degree"), "bucket-members")
    forget(buckets)
    hubs = members_of.groupBy("band").agg(F.max_by("node", F.struct(F.col("degree"), -F.col("node"))).alias("hub"))
    pairs = members_of.join(hubs, "band").where(F.col("node") != F.col("hub")).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    new = written(pairs, "pairs")
    links = written(confirmed(surviving(new, nodes, percent, bands_of * rows_of), candidates, size, percent).where("linked").select("a", "b"), "links")
    joined = written(components(links), "components")
    held = members_of.join(joined, "node", "left").select("band", "node", F.coalesce("component", "node").alias("c"))
    mixed = held.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).where((F.col("c0") != F.col("c1")) & (F.col("n") > 2))
    still = written(held.join(mixed.select("band"), "band"), "open")
    forget(new, joined, members_of, degrees)
    if not still.isEmpty():
        links = links.unionByName(written(tiled_links(still, candidates, nodes, size, percent), "links"))
    own = members.where(F.col("doc_id") != F.col("node")).select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    # rows of one doc_id are one node: their classes are linked through it
    whole = written(components(links.unionByName(own)), "components")
    out = sketches.join(whole, sketches.doc_id == whole.node, "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


ORACLE = {
    "op2_near_duplicates": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
        s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.doc_id WHERE r.c < s.b),
        m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""
}
