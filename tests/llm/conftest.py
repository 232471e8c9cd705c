"""Small tables with the awkward rows that every operator has to take."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest_llm import prose  # noqa: E402

@pytest.fixture(scope="session")
def make(spark):
    def docs(rows, extra=True):
        """rows: (doc_id, text); with columns whose names clash with those of results."""
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:
            frame = frame.selectExpr("*", "'x' AS lang", "1 AS n_tokens", "2 AS component_id", "'s' AS score", "3 AS n", "4 AS key", "5 AS h", "6 AS start", "7 AS size")
        return frame

    return docs


@pytest.fixture(scope="session")
def awkward():
    """Null and empty texts, blanks, repeated rows and ids, a long text, other scripts."""
    return [(1, None), (2, ""), (3, " \n\t "), (4, prose(4, 40)), (4, prose(4, 40)), (5, prose(4, 40)), (6, "x" * 70_000), (7, prose(7, 3000)), (8, "日本語 текст é́ \U0001f600 'll don't"), (None, "no id here at all"), (None, None)]
