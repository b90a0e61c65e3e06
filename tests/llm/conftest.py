import pytest

LONG = " ".join(f"w{i}" for i in range(400))
ROWS = [
    (1, LONG, "en", "a"), (2, LONG.replace("w200", "other"), "en", "a"), (3, LONG, "en", "b"), (4, None, "en", None), (5, "", None, "b"), (6, " \t\n ", "de", "a"),
    (7, "short text", "de", "a"), (8, "Short  Text", "de", "c"), (9, "one two three four five six seven", "fr", "c"), (9, "one two three four five six seven", "fr", "c"),
    (None, "a row without id", "en", "a"), (10, "x" * 5000, "en", "a"), (11, "é ü ñ 日本 \U0001f600", "es", "b"), (12, "the " * 3000, "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, long and repeated rows, and extra columns with the names that operators use inside."""
    rows = spark.createDataFrame(ROWS, SCHEMA)
    return rows.selectExpr("*", "length(text) as n_chars", "1 as node", "2 as rank", "'x' as bin", "3 as size", "4 as row", "5 as word", "6 as pii_spans", "7 as hb_row", "8 as copies")


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
