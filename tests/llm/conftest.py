import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 700}x{i}" for i in range(30_000))
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "s", 1),
    (1, "one two three four five six seven eight nine ten eleven twelve", "en", "s", 1),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (None, "no id but quite a few words to look at in this line here", "en", None, 5),
    (4, LONG, "fr", "s", len(LONG)),
    (5, "ünïcode \x0b\x0c tabs\t\n\n日本 😀 end", "de", "s", 3),
    (6, " \n \t ", "en", "s", 5),
]


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash with those of results."""
    d = spark.createDataFrame(ROWS, DOCS)
    return d.selectExpr("*", "'x' AS kept", "1 AS n_words", "2 AS start", "3 AS component_id", "4 AS cls", "5 AS spans", "6 AS key")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
