import pytest

ODD = "doc_id long, text string, _k int, lang string"


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    long = " ".join(f"w{i}" for i in range(9000))
    rows = [(1, None, 1, "en"), (2, "", 1, "en"), (None, "a b c", 1, None), (None, "a b c", 2, None), (3, "x", 1, "en"), (4, long, 1, "en"), (4, long, 1, "en"), (5, long + " tail", 3, "en"), (6, "É   ß ＡＢ 😀\n\nline two", 1, "fr")]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], ODD)
