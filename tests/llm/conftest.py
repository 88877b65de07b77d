import pytest


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    long_text = "lorem ipsum dolor sit amet " * 8000
    rows = [
        (1, None, "en", "s", 0, "x"),
        (2, "", None, None, None, None),
        (3, " \n\t ", "en", "s", 4, "y"),
        (4, "One small text of a few words.", "en", "s", 30, "z"),
        (4, "One small text of a few words.", "en", "s", 30, "z"),
        (5, "One small text of a few words.", "en", "s", 30, None),
        (None, "A text without an id, café naïve 日本語.", "fr", None, 38, "q"),
        (6, long_text, "en", "s", len(long_text), "r"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row` string")
