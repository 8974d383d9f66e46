import pytest

TEXTS = [None, "", " \t\n", "One", "one two", "The cat sat on the mat, again and again.", "The cat  sat\non the mat, again and again.", "Größe 12 naïve x 'll <|endoftext|> ok", "x" * 3000, "ab " * 4000]


@pytest.fixture
def awkward(spark):
    """NULLs, empty and long texts, ties, repeated rows, and columns named like internal or result ones."""
    rows = [(i, t, "en" if i % 3 else None, i, "x") for i, t in enumerate(TEXTS)] + [(3, "One", "de", 1, "y"), (3, "One", "de", 1, "y"), (None, "One", "en", 2, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, kept long, block string")


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, kept long, block string")


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(10)] + [(None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
