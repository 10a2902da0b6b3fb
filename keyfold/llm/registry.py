"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyfold.llm import bpe, language, lempel, mixing, near, packing, quality, rules, suffix, vafile

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found = [
        language.op1_language_model,
        near.op2_near_duplicates,
        bpe.op3_bpe_encode_decode,
        vafile.op4_exact_top_k,
        quality.op5_quality_classifier,
        rules.op6_quality_rules,
        packing.op7_bit_packed_ids,
        mixing.op8_entropy_mixing,
        suffix.op9_suffix_dedup,
        lempel.op10_substring_dedup,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {**near.ORACLE, **vafile.ORACLE, **rules.ORACLE, **suffix.ORACLE, **lempel.ORACLE}
