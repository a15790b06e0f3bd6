import pytest


@pytest.fixture
def docs(spark):
    """A table of (doc_id, text) rows with clashing further columns."""

    def make(rows):
        return spark.createDataFrame([(i, t, "x", 0, 1.5) for i, t in rows], "doc_id bigint, text string, removed string, key int, score double")

    return make


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "Word"), (4, "Word"), (None, "no id"), (5, "ü 😀 日本語 it's"), (6, "a " * 30000)]


@pytest.fixture
def odd():
    return ODD
