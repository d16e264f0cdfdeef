import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, kind string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing extra columns."""
    long = "word " * 30_000
    rows = [(1, None, None, None, None, "x", "y", "z"), (2, "", "en", "a", 0, None, None, None),
            (3, " \n\t ", "en", None, 4, "x", "y", "z"), (None, "a text without an id here", None, "a", 9, "x", "y", "z"),
            (4, long, "en", "a", len(long), "x", "y", "z"), (5, "same words in this text", "en", "b", 23, "x", "y", "z"),
            (5, "same words in this text", "en", "b", 23, "x", "y", "z"), (6, "same words in this text", "en", "b", 23, "x", "y", "z"),
            (6, "ünïcödé 𝒳 text", "de", "b", 14, "x", "y", "z")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
