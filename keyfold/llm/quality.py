"""Operator 5: a quality classifier with hierarchical empirical Bayes over hosts and paths.

A document classifier (sparse logistic regression over the hashed words, word parts and measures a text has) gives
each document's own evidence. Its posteriors are summed up by host and by path within host; a path's mean is
shrunk toward its host's and a host's toward the global mean, by prior strengths estimated from the
spread of the site means themselves (method of moments). A document's score is its own log odds plus what
its path adds to the global log odds, with the document left out of its site's sums.

Labels: a document is good if quality is 1 and it isn't toxic. The classifier is fitted on at most about
SAMPLE labelled documents, chosen by a hash of doc_id (the whole set where it is no larger); everything
else covers all documents. If labels of both kinds are missing, every document scores 0 and is kept.

A null text is as an empty one; null host or path is a site of its own; repeated rows count and are scored
each; of contradicting labels the worse one holds; labels without doc_id or quality are left out. Extra
columns are kept, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyfold.llm import kernels as K
from keyfold.llm.common import bounded_batches, forget, only, table, unused, written

#: Labelled documents the classifier is fitted on, at most about; hashed features; regularisation.
SAMPLE, LOG_FEATURES, REG = 20_000, 17, 1e-4
FEATURES = 1 << LOG_FEATURES
#: A feature gets a weight if at least LEAST documents of the sample have it, and one in RARE.
LEAST, RARE = 5, 1000
#: The fit asks for the loss some hundred times. Of five parts it is summed in two stages, of more in three; each stage
#: costs the driver buffers of several MB.
PARTS = 5
#: ASCII characters that are neither letters nor digits nor white space.
MARK = np.array([b < 128 and not chr(b).isalnum() and not K.SPACE[b] for b in range(256)])
#: Weight of the site's evidence against the document's own, and bounds of a prior's strength in documents.
SITE_WEIGHT, WEAKEST, STRONGEST = 0.5, 5.0, 1e4


def marks(buf: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 belong to neither letters nor digits nor white space: ASCII marks, those of Latin-1 (C2 ..)
    and general punctuation (E2 80 .., E2 81 ..). All other characters of several bytes count as letters."""
    out = MARK[buf]
    after = np.r_[buf[1:], np.zeros(2, np.uint8)]
    two, three = np.flatnonzero(buf == 0xC2), np.flatnonzero((buf == 0xE2) & ((after[: len(buf)] & 0xFE) == 0x80))
    for at, n in ((two, 2), (three, 3)):
        for k in range(n):
            out[np.minimum(at + k, len(buf) - 1)] = True
    return out


def hashed_features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of what each text has, each once, in order: its words in lower case (ASCII and Latin-1) without
    marks, the first six letters of each, the last two characters of each word as it stands, and its measures in tenths:
    distinct words, capitals, marks, word length, and its size in doublings."""
    docs = len(offs) - 1
    marked = marks(buf) if len(buf) else np.zeros(0, bool)
    after = np.r_[buf[1:], np.zeros(1, np.uint8)][: len(buf)]
    wide = (buf == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
    capitals = ((buf >= 65) & (buf <= 90)) | wide
    low = K.LOWER[buf]
    low[np.flatnonzero(wide) + 1] += 0x20
    plain = (buf & 0xC0) != 0x80  # the first byte of each character
    at, before = np.flatnonzero(plain), np.r_[0, np.cumsum(plain)]
    starts, ends, doc = K.word_spans(np.where(marked, np.uint8(32), buf), offs)
    sums = K.byte_sums(low)
    sixth = np.r_[at, len(buf)][np.minimum(before[starts] + 6, len(at))]
    words, parts = K.spans_hash(sums, starts, ends), K.spans_hash(sums, starts, np.minimum(ends, sixth))
    first, last, own = K.word_spans(buf, offs)
    second = at[np.maximum(before[last] - 2, 0)] if len(at) else first
    tail = K.spans_hash(K.byte_sums(buf), np.maximum(first, second), last)
    n = np.maximum(np.bincount(own, minlength=docs), 1)
    per_doc = lambda flags: np.diff(np.r_[0, np.cumsum(flags)][offs])
    chars = np.maximum(per_doc(plain), 1)
    order = np.lexsort((words, doc))
    new = np.ones(len(order), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=docs)
    tenths = [distinct / n, per_doc(capitals) / chars, per_doc(marked & plain) / chars, chars / n / 20]
    measures = [np.floor(10 * x).astype(np.uint64) for x in tenths] + [np.floor(np.log2(n)).astype(np.uint64)]
    every = np.arange(docs)
    found = [(doc, words), (doc, parts ^ np.uint64(0x9E3779B97F4A7C15)), (own, tail ^ np.uint64(0xC2B2AE3D27D4EB4F))]
    found += [(every, K.mix(x + (np.uint64(2 + i) << np.uint64(40)))) for i, x in enumerate(measures)]
    whole = np.concatenate([d.astype(np.uint64) * np.uint64(FEATURES) + (h >> np.uint64(64 - LOG_FEATURES)) for d, h in found])
    whole.sort()
    fresh = np.ones(len(whole), bool)
    fresh[1:] = whole[1:] != whole[:-1]
    whole = whole[fresh]
    return (whole >> np.uint64(LOG_FEATURES)).astype(np.int64), (whole & np.uint64(FEATURES - 1)).astype(np.int64)


def features(docs: DataFrame, held: str, text: str = "text") -> DataFrame:
    """(held, features): the sorted numbers of the hashed features each text has."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{held}`").alias("held"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = K.text_buffer(batch.column(1))
            for first, end in K.pieces(offs, K.SMALL):
                doc, feature = hashed_features(buf[offs[first] : offs[end]], offs[first : end + 1] - offs[first])
                lists = K.list_array(feature, np.bincount(doc, minlength=end - first), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), lists], names=["held", "features"])

    schema = T.StructType([T.StructField("held", rows.schema["held"].dataType), T.StructField("features", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, schema).withColumnRenamed("held", held)


def labelled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label) of a bounded, hash-chosen sample; one row for each document."""
    rows = only(labels, doc_id="bigint", quality="int", toxic="int").where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    rows = rows.groupBy("doc_id").agg(F.min(good.cast("double")).alias("label"))
    keep = -(-max(rows.count(), 1) // sample)
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(keep)) == 0)


@dataclass(frozen=True)
class Classifier:
    """A weight for each hashed feature, the intercept, and how many steps the fit may take."""

    weights: np.ndarray
    intercept: float
    steps: int

    def getMaxIter(self) -> int:
        return self.steps


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """The document classifier, None if the sample doesn't hold both kinds. The sample (16 bytes a row) is broadcast.
    Features that few documents of it have get no weight."""
    few = labelled(labels, sample)
    rows = only(docs, doc_id="bigint", text="string").join(F.broadcast(few), "doc_id").select("label", "text")
    found = written(features(rows, "label"), "features")
    n, kinds = found.agg(F.count("*"), F.count_distinct("label")).first()
    often = found.select(F.explode("features").alias("f")).groupBy("f").count().where(F.col("count") >= max(LEAST, n / RARE)).select("f")
    kept = np.sort(often.toArrow().column("f").to_numpy())  # at most FEATURES numbers
    if not len(kept) or kinds < 2:
        return None

    def vector(x: list[int]) -> SparseVector:
        at = np.minimum(np.searchsorted(kept, x), len(kept) - 1)
        at = at[kept[at] == np.array(x)]
        return Vectors.sparse(len(kept), at, np.ones(len(at)))

    train = written(found.select("label", F.udf(vector, VectorUDT())("features").alias("features")), "train")
    model = LogisticRegression(featuresCol="features", labelCol="label", regParam=REG, elasticNetParam=1.0, maxIter=80, standardization=False, aggregationDepth=2).fit(train.coalesce(PARTS))
    weights = np.zeros(FEATURES)
    weights[kept] = model.coefficients.toArray()
    forget(found, train)
    return Classifier(weights, model.intercept, model.getMaxIter())


def evidence(docs: DataFrame, model: Classifier | None, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """docs, or some of their columns, with doc_logit, the classifier's log odds of good."""
    held = [c for c in (docs.columns if columns is None else columns) if c != "doc_logit"]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in held], F.lit(0.0).alias("doc_logit"))
    spark = docs.sparkSession
    bounded_batches(spark)
    weights = spark.sparkContext.broadcast((model.weights, model.intercept))  # a number for each feature

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, intercept = weights.value
        for batch in batches:
            buf, offs = K.text_buffer(batch.column(0))
            for first, end in K.pieces(offs, K.SMALL):
                doc, feature = hashed_features(buf[offs[first] : offs[end]], offs[first : end + 1] - offs[first])
                logit = intercept + np.bincount(doc, weight[feature], minlength=end - first)
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns[1:], pa.array(logit)], names=[*[f"c{i}" for i in range(len(held))], "doc_logit"])

    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(held)])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("doc_logit", T.DoubleType())])
    return rows.mapInArrow(run, schema).toDF(*held, "doc_logit")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_odds(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, n: str, mean: str, parent: str, name: str) -> DataFrame:
    """One row: the prior's strength at a level. The spread of group means around their parents beyond what
    documents alone would bring gives the variance of true means, and that the strength."""
    g = groups.where(F.col(n) > 1)
    spread = F.sum(F.col(n) * (F.col(mean) - F.col(parent)) ** 2) / F.sum(n)
    noise = F.sum(F.col(parent) * (1 - F.col(parent))) / F.sum(n)
    inner = F.sum(F.col(n) * F.col(parent) * (1 - F.col(parent))) / F.sum(n)
    m = inner / F.greatest(spread - noise, F.lit(1e-9)) - 1
    return g.agg(F.greatest(F.least(F.coalesce(m, F.lit(STRONGEST)), F.lit(STRONGEST)), F.lit(WEAKEST)).alias(name))


def sites(scored: DataFrame, host: str, path: str) -> DataFrame:
    """A row for each (host, path): document counts and posterior sums of path, host and all, and the prior
    strengths. One shuffle of pre-aggregated sums; a hot host arrives as one row from each task."""
    p = sigmoid(F.col("doc_logit"))
    paths = written(scored.groupBy(F.col(host).alias("_host"), F.col(path).alias("_path")).agg(F.count("*").cast("double").alias("n_path"), F.sum(p).alias("s_path")), "sites")
    hosts = paths.groupBy("_host").agg(F.sum("n_path").alias("n_host"), F.sum("s_path").alias("s_host"))
    everything = paths.agg(F.sum("n_path").alias("n_all"), F.sum("s_path").alias("s_all"))
    hosts = hosts.crossJoin(F.broadcast(everything))  # everything is one row
    h = hosts.withColumn("mean", F.col("s_host") / F.col("n_host")).withColumn("parent", F.col("s_all") / F.col("n_all"))
    renamed = hosts.withColumnRenamed("_host", "_h")
    both = paths.join(renamed, paths._host.eqNullSafe(renamed._h)).drop("_h")
    q = both.withColumn("mean", F.col("s_path") / F.col("n_path")).withColumn("parent", F.col("s_host") / F.col("n_host"))
    out = both.crossJoin(F.broadcast(strength(h, "n_host", "mean", "parent", "m_host"))).crossJoin(F.broadcast(strength(q, "n_path", "mean", "parent", "m_path")))
    return written(out, "site-priors")


def classify(docs: DataFrame, model: Classifier | None, by_site: DataFrame, host: str = "source", path: str = "lang", text: str = "text") -> DataFrame:
    """docs with doc_logit, host_posterior, path_posterior, score (log odds of good) and kept (score >= 0)."""
    d = docs if "doc_logit" in docs.columns else evidence(docs, model, text)
    d = d.drop("host_posterior", "path_posterior", "score", "kept")
    of = dict(zip(by_site.columns, unused(d.columns, *(f"_{c.lstrip('_')}" for c in by_site.columns)), strict=True))
    joined = d.join(by_site.withColumnsRenamed(of), F.col(f"`{host}`").eqNullSafe(F.col(of["_host"])) & F.col(f"`{path}`").eqNullSafe(F.col(of["_path"])))
    site = lambda c: F.col(of[c])
    p, overall = sigmoid(F.col("doc_logit")), site("s_all") / site("n_all")
    host_post = (site("s_host") - p + site("m_host") * overall) / (site("n_host") - 1 + site("m_host"))
    path_post = (site("s_path") - p + site("m_path") * F.col("host_posterior")) / (site("n_path") - 1 + site("m_path"))
    out = joined.withColumn("host_posterior", host_post).withColumn("path_posterior", path_post)
    out = out.withColumn("score", F.col("doc_logit") + SITE_WEIGHT * (log_odds(F.col("path_posterior")) - log_odds(overall)))
    return out.withColumn("kept", F.col("score") >= 0).drop(*of.values())


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    rows = only(docs, doc_id="bigint", source="string", lang="string", text="string")
    slim = written(evidence(rows, model, columns=["doc_id", "source", "lang"]), "evidence")
    out = classify(slim, model, sites(slim, "source", "lang"))
    return out.select("doc_id", "doc_logit", "host_posterior", "path_posterior", "score", "kept")
