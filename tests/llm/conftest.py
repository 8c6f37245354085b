import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with an extra column whose name clashes with results."""

    def make(texts, sources=None, ids=None, langs=None):
        n = len(texts)
        rows = [((ids or range(n))[i], texts[i], (langs or ["en"] * n)[i], (sources or ["a"] * n)[i], None, "mine") for i in range(n)]
        return spark.createDataFrame(rows, DOC + ", score string")

    return make


@pytest.fixture()
def rnd():
    return random.Random(7)


#: Null, empty, white space, emoji, long, repeated, and one word.
ODD = [None, "", " \n\t", "😀 é 漢字", "word " * 30_000, "same text here", "same text here", "x"]
