from __future__ import annotations

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, kept int, digest string"


def documents(spark, rows):
    """Documents with two columns more, whose names the operators use, too."""
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, "x") for i, t, lang in rows], DDL)


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, a null id, copies, repeated rows, blank texts, a long text and one without spaces."""
    long_text = " ".join(f"word{i % 977} and{i % 13}" for i in range(20000))
    rows = [
        (1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, "the same text", "en"), (5, "the same text", "de"), (5, "the same text", "de"), (None, "no id", "en"),
        (6, long_text, "en"), (7, "x" * 5000, "en"), (8, "thesametext", "fr"), (9, "ÄÖ Ünï 漢字 \U0001f600 12.5", "de"), (10, "1234 5678", "en"),
    ]
    return documents(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])
