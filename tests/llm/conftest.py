import pytest

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, h int, th int, rep int"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = "wort und satz " * 20_000
    rows = [
        (1, None, "en", "a", 0, 1.0, "x", 1, 1, 1), (2, "", None, None, 0, None, None, None, None, None), (3, "  \n\t", "en", "b", 4, 1.0, "x", 1, 1, 1),
        (4, "same text here", "en", "a", 14, 1.0, "x", 1, 1, 1), (5, "same text here", "de", "b", 14, 1.0, "x", 1, 1, 1), (6, "Same  text\nhere", "de", None, 14, 1.0, "x", 1, 1, 1),
        (7, long, "de", "a", len(long), 1.0, "x", 1, 1, 1), (8, long, "de", "a", len(long), 1.0, "x", 1, 1, 1), (None, "no id at all", "en", "c", 12, 1.0, "x", 1, 1, 1),
        (9, "12345 !!", "en", "c", 8, 1.0, "x", 1, 1, 1), (10, "ünïcode é\U0001f600 ÀB", None, "é", None, 1.0, "x", 1, 1, 1),
        (10, "ünïcode é\U0001f600 ÀB", None, "é", None, 1.0, "x", 1, 1, 1), (11, "one\ntwo\n\nthree\n", "fr", "a", 16, 1.0, "x", 1, 1, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
