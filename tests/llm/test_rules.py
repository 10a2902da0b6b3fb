from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from keyfold.llm import rules
from tests.compare import same
from tests.llm.conftest import odd_rows, prose

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(text):
    t = text or ""
    w = [x.decode() for x in t.encode().split()]
    lines = [x for x in t.split("\n") if x.encode().split()]
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    in_repeat = {j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(in_repeat))


def test_odd_documents(clashing):
    out = rules.quality_rules(clashing)
    assert set(clashing.columns) <= set(out.columns)
    assert {tuple(r) for r in out.select("_w", "_lines").distinct().collect()} == {("own _w", "own _lines")}
    got = Counter((r.doc_id, *(r[c] for c in BASE)) for r in out.collect())
    assert got == Counter((r[0], *brute(r[1])) for r in odd_rows())
    for r in out.collect():
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.base_failed and r.kept)


def test_empty_table(nothing):
    assert rules.quality_rules(nothing).count() == 0


@pytest.mark.parametrize(
    "line,fails",
    [
        ("An ordinary sentence that ends as it should.", False), ("Eine Überschrift mit fünf Wörtern ohne Punkt", False), ("Home | About | Contact", True), ("Menu", True), ("All rights reserved.", True),
        ("One. Two.", False), ("BUY!! NOW!! CHEAP!! Offers today only!!", True), ("a$$$ b%%% c### d&&& e*** f", True), ("Licensed under the Apache License, Version 2.0.", True), ("He said “yes.”", False),
        ("A | in the middle is fine in a sentence.", False),
    ],
)
def test_lines(spark, line, fails):
    df = spark.createDataFrame([(line,)], "x string")
    assert df.select(rules.line_fails(F.col("x"))).first()[0] is fails


def test_good_text_stays_and_bad_lines_go(spark):
    good = "\n".join(" ".join(f"word{i}{j}" for j in range(12)) + "." for i in range(9))
    rows = [(1, good), (2, "Home | About | Contact\n" + good + "\nAll rights reserved."), (3, "\n".join("a | b | c | d | e | f | g" + str(i) for i in range(30)) + "\n" + prose(9, 20) + ".")]
    out = {r.doc_id: r for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert out[1].kept and out[1].clean_text == good and out[1].n_lines_removed == 0
    assert out[2].kept and out[2].clean_text == good and out[2].n_lines_removed == 2
    assert not out[3].kept and out[3].kept_share < 0.5


def test_plan_is_native(odd):
    plan = rules.quality_rules(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query(spark):
    same(rules.op6_quality_rules(spark, "/root/testdata/sf0.01"), rules.ORACLE["op6_quality_rules"], "/root/testdata/sf0.01")
