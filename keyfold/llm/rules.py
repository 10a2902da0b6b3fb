"""Operator 6 [native]: line-first quality rules, in DataFrame functions only.

Rules for punctuation, navigation and boilerplate judge each line; lines that fail are removed, and a
document that loses too much of its text with them is rejected. Measures of the whole text (words,
symbols, repeated lines, repeated 3-word windows) reject hopeless documents before.

Everything happens within a document's row: no shuffle, no limit on length. A null or empty text has no
words and no lines: it fails the base rules. Repeated rows are judged each; other columns are kept, those
named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm.common import only, table, unused

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Lines like these are said on every site.
BOILERPLATE = (
    r"(?i)\b(all rights reserved|copyright \(?c?\)?|licensed under|terms of (use|service)|privacy policy|cookie policy|use of cookies"
    r"|enable javascript|subscribe to our newsletter|click here|sign in|log in|read more|lorem ipsum)\b"
)
#: Two or more separators, or words strung together by arrows or dots.
NAVIGATION = r"(\|[^|]*\|)|( [>»›•·] .* [>»›•·] )"
#: A line that stops like a sentence, possibly within quotes or brackets.
STOPS = r"[.!?…。！？:;]['\"”’»)\]]*[\x20\x09-\x0D]*$"
SHOUTING = r"([!?]{2,}[^!?]*){3}"
#: Words a line without a stop must have; share of symbols among a line's characters; share of a text's
#: characters in good lines below which the text is rejected.
LINE_WORDS, LINE_SYMBOLS, KEPT_SHARE = 5, 0.1, 0.5


def word_count(text: Column) -> Column:
    """How many words a text has: one piece fewer than the words cut it into."""
    return F.size(F.split(text, r"[^\x20\x09-\x0D]+")) - 1


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def line_fails(line: Column) -> Column:
    """The line rules: navigation, boilerplate, punctuation (too many symbols, shouting, fragments without a stop)."""
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    fragment = ~line.rlike(STOPS) & (word_count(line) < LINE_WORDS)
    return line.rlike(NAVIGATION) | line.rlike(BOILERPLATE) | line.rlike(SHOUTING) | (symbols > LINE_SYMBOLS * F.length(line)) | fragment


def clean_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with clean_text (the good lines), n_lines, n_lines_removed and kept_share (of the characters in lines)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), has_word)
    all_lines, good = unused(docs.columns, "_lines", "_good")
    out = docs.withColumn(all_lines, lines).withColumn(good, F.filter(all_lines, lambda x: ~line_fails(x)))
    chars = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    total = chars(all_lines)
    return out.withColumns(
        {
            "clean_text": F.array_join(good, "\n"),
            "n_lines": F.size(all_lines).cast("bigint"),
            "n_lines_removed": (F.size(all_lines) - F.size(good)).cast("bigint"),
            "kept_share": F.when(total > 0, chars(good) / total).otherwise(0.0),
        }
    ).drop(all_lines, good)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text.

    For the repeated windows: hashes of all 3-word windows are sorted within the row, equal neighbours are
    the repeated ones, and the words that their starts cover are counted from the starts in order.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words, lines, sorted_, starts = unused(docs.columns, "_w", "_l", "_s", "_d")
    out = docs.withColumn(words, F.filter(F.split(t, SPACES), lambda x: x != "")).withColumn(lines, F.filter(F.split(t, "\n"), has_word))
    n = F.size(words)
    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    out = out.withColumn(sorted_, F.sort_array(F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window)).otherwise(F.array())))
    same = lambda k, x: F.coalesce(F.get(sorted_, k).getField("h") == x.getField("h"), F.lit(False))
    out = out.withColumn(starts, F.sort_array(F.transform(F.filter(sorted_, lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x.getField("i"))))
    covered = F.aggregate(F.transform(starts, lambda x, k: F.least(F.coalesce(F.get(starts, k + 1) - x, F.lit(3)), F.lit(3))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.withColumns(
        {
            "n_words": n.cast("bigint"),
            "word_chars": F.length(F.regexp_replace(t, SPACES, "")).cast("bigint"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
            "n_repeat_words": covered,
        }
    ).drop(words, lines, sorted_, starts)


def quality_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures, the cleaned text, base_failed and kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = clean_lines(measures(docs, text), text)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("kept_share") >= KEPT_SHARE))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), doc_id="bigint", text="string")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_lines_removed")


_W = r"[^\x20\x09-\x0D]"
ORACLE = {
    "op6_quality_rules": rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        a AS (SELECT doc_id, t, regexp_extract_all(t, '{_W}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS l FROM t),
        win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
        rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
        cov AS (SELECT doc_id, sum(least(3, coalesce(nx - i, 3))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep) GROUP BY doc_id),
        g AS (SELECT *, list_filter(l, lambda x: NOT (regexp_matches(x, '{NAVIGATION}') OR regexp_matches(x, '{BOILERPLATE}') OR regexp_matches(x, '{SHOUTING}')
                OR length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) > {LINE_SYMBOLS} * length(x)
                OR (NOT regexp_matches(x, '{STOPS.replace("'", "''")}') AND len(regexp_extract_all(x, '{_W}+')) < {LINE_WORDS}))) AS good FROM a),
        m AS (SELECT g.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
                CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(good) AS BIGINT) AS n_lines_removed,
                coalesce(list_sum(list_transform(good, lambda x: length(x))), 0) AS ok_chars, coalesce(list_sum(list_transform(l, lambda x: length(x))), 0) AS all_chars
              FROM g LEFT JOIN cov ON cov.doc_id = g.doc_id),
        f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok_chars >= {KEPT_SHARE} * all_chars AS kept, n_lines, n_lines_removed FROM f"""
}
