import pytest

ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a"),
    (2, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a"),
    (3, None, None, None),
    (4, "", "fr", "b"),
    (5, " \t\n\x0b ", "fr", None),
    (6, "one", "de", "b"),
    (7, "été très bon \U0001f600 ß", "fr", ""),
    (None, "a b c d e f", "es", "c"),
    (8, "word " * 30000, "en", "a"),
    (8, "word " * 30000, "en", "a"),
    (9, "x" * 200000, "en", "hot"),
    (10, "line one two three\nline one two three\n\nother", "en", "hot"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns with clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("n_chars", "fp", "size", "root", "src", "word", "n", "key", "shard", "turn", "pos")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")
