import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_rows import EDGE  # noqa: E402


@pytest.fixture
def documents(spark):
    """Builds a documents table; extra columns have names that operators use inside."""

    def build(rows):
        data = [(k, t, "en", "s", None, k, "x") for k, t in rows]
        return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, row string")

    return build


@pytest.fixture
def edge(documents):
    return documents(EDGE)
