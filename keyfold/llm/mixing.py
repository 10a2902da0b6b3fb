"""Operator 8 [native]: mixing sources to target token counts by entropy balancing, in DataFrame functions only.

Document rates w stay as near to 1 as they can: they minimise the sum of w ln w - w + 1 over documents under one
constraint for each source, that size * w sums to the source's target, and w at most cap. The convex dual has one
multiplier for each source, and the rates are min(cap, exp(multiplier * size / mean size)): a source that is to
shrink loses long documents first, one that is to grow repeats them first. Newton's iterations solve the dual for all
sources at once; each sums up the constraint and its slope over the documents (that is, over how many
there are of each source and size), and is kept within bounds that shrink, so that it can't run away. The rates
are rounded into copies by a hash of the document; what a source then lacks or has too much is mended with a
few of its documents, taken from a ladder of sizes.

A null or empty text has size 0 and is taken 0 times its size. A null source is a source of its own, the
last one. Rows with equal doc_id, source and size are rounded alike. Other columns are kept.
The table of sources (a row each) is ordered in one task; documents never are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.llm.common import forget, only, table, written
from keyfold.llm.rules import word_count

#: Steps of the ladder for each doubling of the size.
STEPS = 4
#: Newton's iterations at most, and how near, in parts of the target, a constraint is to be met.
NEWTON, NEAR = 40, 1e-6
#: Sums are made of whole parts of a word, so that they don't depend on the order of the rows.
FINE = 1e6


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, n): the words of each text; n rows are alike."""
    rows = only(docs, doc_id="bigint", source="string", text="string")
    size = word_count(F.coalesce("text", F.lit(""))).cast("bigint")
    return rows.select("doc_id", "source", size.alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))


def targets(sources: DataFrame, share: float, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size) with target: share of all sizes, dealt out by weight; what is above cap times a
    source's size is dealt out again among the others.

    Sources reach their caps in the order of cap * size / weight, so the last round of dealing is found
    from sums over this order.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))))
    s = sources.withColumn("w", weight).withColumn("top", cap * F.col("source_size"))
    order = W.orderBy(F.col("top") / F.col("w"), F.col("source").isNull(), "source")
    everything = W.partitionBy()
    before = F.coalesce(F.sum("top").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    s = s.withColumn("budget", share * F.sum("source_size").over(everything)).withColumn("full", F.col("top") * rest <= F.col("w") * (F.col("budget") - before))
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("top"))).over(everything), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    return s.withColumn("target", F.when(F.col("full"), F.col("top")).otherwise(F.col("w") * left / open_weight)).select("source", "source_size", "target")


def document_rate(cap: float) -> Column:
    """A document's rate from its source's multiplier; `fixed` is the rate where the constraint needs no solving."""
    tilt = F.col("multiplier") * F.col("size") / F.col("scale")
    return F.coalesce(F.col("fixed"), F.when(tilt >= math.log(cap), F.lit(float(cap))).otherwise(F.exp(tilt)))


def balanced(docs_sizes: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """sources (source, source_size, target) with scale, fixed and multiplier, which document_rate() reads.

    A source without words or target has rate 0, one whose target is cap times its size has rate cap. For the others the
    iteration goes on until all constraints are met; each one is a grouped sum over the documents' sizes.
    """
    by_size = written(docs_sizes.where("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-histogram")
    scale = by_size.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale")).withColumnRenamed("source", "_source")
    s = sources.join(scale, sources.source.eqNullSafe(F.col("_source")), "left").drop("_source")
    nothing, everything = F.col("scale").isNull() | (F.col("target") <= 0), F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    s = s.withColumn("fixed", F.when(nothing, 0.0).when(everything, float(cap)))
    # at these a document of one word has rate cap, or next to none
    s = s.withColumns({"multiplier": F.lit(0.0), "low": -60 * F.col("scale"), "high": math.log(cap) * F.col("scale"), "miss": F.when(F.col("fixed").isNull(), F.lit(float("inf"))).otherwise(0.0)})
    state = written(s, "mix-multipliers")
    fine = lambda x: F.sum((F.col("n") * F.col("size") * x * FINE).cast("decimal(38,0)")).cast("double") / FINE
    for _ in range(NEWTON):
        going = state.where(F.col("miss") > NEAR)
        if going.isEmpty():
            break
        one = going.select(F.col("source").alias("_source"), "scale", "fixed", "multiplier")
        rate, inside = document_rate(cap), F.col("multiplier") * F.col("size") / F.col("scale") < math.log(cap)
        sums = by_size.join(one, by_size.source.eqNullSafe(F.col("_source"))).groupBy("_source").agg(fine(rate).alias("sum"), fine(F.when(inside, rate * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"))
        step = state.join(sums, state.source.eqNullSafe(F.col("_source")), "left").drop("_source")
        known = F.col("sum").isNotNull()
        step = step.withColumn("low", F.when(known & (F.col("sum") < F.col("target")), F.col("multiplier")).otherwise(F.col("low")))
        step = step.withColumn("high", F.when(known & (F.col("sum") >= F.col("target")), F.col("multiplier")).otherwise(F.col("high")))
        # Newton's step on the logarithm of the constraint, which is straighter than the constraint itself
        there = F.col("multiplier") - F.log(F.col("sum") / F.col("target")) * F.col("sum") / F.col("slope")
        there = F.when((F.col("slope") > 0) & (F.col("sum") > 0) & (there > F.col("low")) & (there < F.col("high")), there).otherwise((F.col("low") + F.col("high")) / 2)
        miss = F.abs(F.col("sum") / F.col("target") - 1)
        step = step.withColumn("miss", F.when(known, miss).otherwise(F.col("miss")))
        step = step.withColumn("multiplier", F.when(known & (F.col("miss") > NEAR), there).otherwise(F.col("multiplier"))).drop("sum", "slope")
        before, state = state, written(step, "mix-multipliers")
        forget(before)
    return state.drop("low", "high", "miss")


def chance() -> Column:
    """A number in [0, 1) that belongs to a document."""
    return F.pmod(F.xxhash64("doc_id", "size", F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))


def key() -> Column:
    return F.xxhash64("doc_id", "size", F.lit("ladder"))


def rounded() -> Column:
    """Copies before mending: the rate's whole part, and one more with its fraction as probability. A rate that
    is a whole number but for rounding errors counts as whole."""
    whole = F.floor(F.col("rate") + 1e-9)
    return whole + F.when(chance() < F.col("rate") - whole - 1e-9, 1).otherwise(0)


def plan(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), cap: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(sources, sizes): for each source its size, target, multiplier and the keys of documents that get one copy
    more (add) or fewer (drop) than their rounded rate; and the written table of sizes()."""
    docs_sizes = written(sizes(docs), "mix-sizes")
    totals = docs_sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_source = balanced(docs_sizes, targets(totals, share, weights, cap), cap)
    held = docs_sizes.join(by_source, docs_sizes.source.eqNullSafe(by_source.source)).drop(by_source.source).withColumn("rate", document_rate(cap))
    tokens = F.col("size") * F.col("n")
    rung = F.floor(STEPS * F.log2(F.greatest(tokens, F.lit(1))))
    one = F.struct(tokens.alias("tokens"), key().alias("key"))
    extra = F.col("copies") > F.floor(F.col("rate") + 1e-9)
    room = F.col("copies") + 1 <= cap
    ladder = held.withColumn("copies", rounded()).groupBy("source", rung.alias("rung")).agg(
        F.sum(F.col("copies") * tokens).alias("taken"), F.max(F.when(~extra & room & (tokens > 0), one)).alias("up"), F.max(F.when(extra & (tokens > 0), one)).alias("down")
    )
    steps = ladder.groupBy("source").agg(F.sum("taken").alias("taken"), F.sort_array(F.collect_list("up"), asc=False).alias("ups"), F.sort_array(F.collect_list("down"), asc=False).alias("downs"))
    zero = lambda lack: F.struct(lack.alias("lack"), F.array().cast("array<bigint>").alias("keys"))
    take = lambda a, x: F.when(x.tokens <= a.lack, F.struct((a.lack - x.tokens).alias("lack"), F.concat(a["keys"], F.array(x["key"])).alias("keys"))).otherwise(a)
    mended = lambda rungs, lack: F.aggregate(rungs, zero(lack), take, lambda a: a["keys"])
    lack = F.col("target") - F.col("taken")
    both = by_source.join(steps.withColumnRenamed("source", "_source"), by_source.source.eqNullSafe(F.col("_source"))).drop("_source")
    done = both.select("source", "source_size", "target", "scale", "fixed", "multiplier", mended(F.col("ups"), lack).alias("add"), mended(F.col("downs"), -lack).alias("drop"))
    return written(done, "mix-plan"), docs_sizes


def with_copies(rows: DataFrame, sources: DataFrame, cap: float = 2.0) -> DataFrame:
    """rows (doc_id, source, size, ...) with source_size, target and copies; cap is that of the plan."""
    s = sources.withColumnRenamed("source", "_source")
    joined = rows.join(s, rows.source.eqNullSafe(s._source)).withColumn("rate", document_rate(cap))
    mend = F.when(F.array_contains("add", key()), 1).when(F.array_contains("drop", key()), -1).otherwise(0)
    return joined.withColumn("copies", rounded() + mend).drop("_source", "rate", "scale", "fixed", "multiplier", "add", "drop")


def mix(docs: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), cap: float = 2.0) -> DataFrame:
    """The mixed documents: each row of docs as many times as the mix takes it, docs' columns only.

    A row without words counts nothing: it is kept once.
    """
    sources, _ = plan(docs, share, weights, cap)
    keys = docs.select(F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.coalesce(F.col("text"), F.lit(""))).cast("bigint").alias("size"))
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).cast("int")
    return with_copies(keys, sources, cap).select("_row", F.explode(F.sequence(F.lit(1), F.greatest(times, F.lit(1)))).alias("_k"), times.alias("_times")).where(F.col("_k") <= F.col("_times")).select("_row.*")


def op8_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, rows = plan(table(spark, sf_dir, "documents"))
    out = with_copies(rows, sources).withColumn("taken", (F.col("copies") * F.col("size")).cast("bigint"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("_k")).drop("_k")
