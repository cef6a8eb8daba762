from __future__ import annotations

import pytest

from basketry.llm.common import prepare

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, doc long, ids string"
LONG = "word%d " * 3000


@pytest.fixture
def documents(spark):
    """Documents with nulls, empty and very long texts, repeats, and clashing extra columns."""
    prepare(spark)

    def build(*texts, first=1):
        rows = [(i, t, "en", "s", None, "r", -1, "x") for i, t in enumerate(texts, first)]
        return spark.createDataFrame(rows, DOCS).repartition(3)

    return build


@pytest.fixture
def awkward(documents):
    long = LONG % tuple(range(3000))
    return documents(None, "", " ", long, long, "é" * 20_000, "one two", "one two", "\n\n\n", "a\x00b \t\r\n c")


@pytest.fixture
def nothing(documents):
    return documents("x").where("false")
