"""A training corpus from raw documents: five stages, each one of the operators in keyfold.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet into the shared
folder and reads it again as the next stage's docs. All but the last return the columns of docs, so
columns of any other name pass through, null texts count as empty, and rows without doc_id are never
taken for duplicates.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import bpe, lempel, mixing, near, quality
from keyfold.llm.common import table, unused, written

#: The mix and the tokens depend on models fitted here and on copies; SQL can't express the stages.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier with its site priors takes for good."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    text = F.col("text").cast("string")
    key = {"doc_id": F.col("doc_id").cast("string"), "source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "hash": F.xxhash64(text)}
    # the evidence is written once; rows equal in these four have equal scores
    slim = written(quality.evidence(docs.select(*[c.alias(n) for n, c in key.items()], text.alias("text")), model, columns=list(key)), "evidence")
    bad = quality.classify(slim, model, quality.sites(slim, "source", "lang")).where(~F.col("kept"))
    names = dict(zip(key, unused(docs.columns, *(f"_{n}" for n in key)), strict=True))
    gone = bad.select(*[F.col(n).alias(name) for n, name in names.items()]).distinct()
    same = [c.eqNullSafe(F.col(names[n])) for n, c in key.items()]
    return docs.join(gone, same[0] & same[1] & same[2] & same[3], "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: five-word shingles, similarity of 0.8 or more.

    The one with the smallest doc_id stays. Rows of one doc_id and one text are one document, of which one row stays;
    rows that have a doc_id in common but not the text are documents of their own.
    """
    ids = F.col("doc_id").cast("bigint")
    (node,) = unused(docs.columns, "_node")
    if docs.where(ids.isNotNull()).groupBy(ids).count().where("count > 1").isEmpty():
        gone = near.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select(F.col("doc_id").alias(node)).distinct()
        return docs.join(gone, ids == F.col(node), "left_anti")
    named = docs.withColumn(node, F.when(ids.isNotNull(), F.xxhash64(ids, F.col("text").cast("string"))))
    found = near.near_duplicates(named.select(F.col(node).alias("doc_id"), "text")).select(F.col("doc_id").alias("n"), "component_id").distinct()
    whole = named.where(ids.isNotNull()).select(F.col(node).alias("n"), ids.alias("id")).distinct().join(found, "n")
    stay = whole.groupBy("component_id").agg(F.min_by("n", F.struct("id", "n")).alias("n")).select(F.col("n").alias(node))
    left = named.where(ids.isNotNull()).join(stay, node, "left_semi").dropDuplicates([node])
    return left.select(docs.columns).unionByName(docs.where(ids.isNull()))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 35 words and more that stand in several places out of the texts; n_chars follows."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    out = lempel.remove_passages(docs.toDF(*names), 35, of["doc_id"], of["text"]).select(*names)
    if "n_chars" in of:
        out = out.withColumn(of["n_chars"], F.length(of["text"]).cast(docs.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that the sources come near their target word counts."""
    return mixing.mix(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, and the digest of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path).select("doc_id", "lang", "source", "ids")
    decoded = bpe.decode(encoded, path)
    return decoded.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources", mixing_to_targets),
    ("BPE encoding", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
