"""Small documents with all that can be odd about them."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "tion", "Erha", "ouÉ", "in.", "it's", "42", "x" * r.randint(1, 9), "ñandú,"]) + str(r.randint(0, 30)) * r.randint(0, 1) for _ in range(words))


def odd_rows() -> list[tuple]:
    passage = prose(7, 60)
    near = prose(8, 120)
    texts = [
        None, "", " \t\n", "one", "Two words", "three little WORDS", passage, passage, prose(1, 50) + "\n" + passage + "\n" + prose(2, 40), passage + " " + passage,
        near, near + " more", near.upper(), "a " * 300, "é́ﬁ Ǆ   \x1c\x1d 漢字かな <|endoftext|> !!", prose(3, 200), "w" * 5000, "\n".join(["Same line here.", "Same line here."] * 3), prose(4, 20_000),
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], [f"src{i % 4}", None, ""][i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], rows[15], (15, prose(5, 80), "en", "src0", 5), (None, passage, None, None, None), (None, prose(6, 70), "en", None, 1), (-3, prose(1, 50), "de", "src9", 0)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(odd):
    """Columns named like those that operators use."""
    from pyspark.sql import functions as F

    out = odd
    for c in ("kept", "score", "n_words", "ids", "decoded", "size", "copies", "d", "k", "h", "row", "_row", "spans", "node", "component_id", "doc_logit", "target", "rate", "_gone", "_gone0", "_features", "_tokens", "_raw", "n_host", "_host", "s_all", "_w", "_lines", "_text", "fixed", "multiplier", "scale", "block", "row_", "_node"):
        out = out.withColumn(c, F.lit(f"own {c}"))
    return out
