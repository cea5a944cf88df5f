import pytest

SCHEMA = "msg_id long, text string, dataset string, lang string, conv_id string, pos long, author string, score string, _at string"


@pytest.fixture(scope="session")
def odd(spark):
    """Messages with nulls in every column, empty and long texts, repeated rows, columns with clashing names."""
    long = " ".join(f"word{i % 997} tail{i % 31}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood", "s1", "en", "c", 0, "a", "x", "y"),
        (2, None, "s1", "en", "c", 1, "b", "x", "y"),
        (3, "", "s2", None, "c", 2, None, None, None),
        (4, " \t\n\r\x0b\x0c ", None, None, None, None, None, None, None),
        (5, long, "s1", "en", "c", 3, "a", "x", "y"),
        (6, long, "s3", "en", "d", 0, "a", "x", "y"),
        (None, "no id here but some words to read in it", None, "en", None, None, None, None, None),
        (7, "gleich gleich", "s2", "de", "d", 1, "b", "x", "y"),
        (7, "gleich gleich", "s2", "de", "d", 1, "b", "x", "y"),
        (8, "x" * 50_000, "s2", None, "e", 0, "a", "x", "y"),
        (9, "é\U0001f600 á <|endoftext|> 12 3 !!", "s2", "fr", "e", 1, "a", "x", "y"),
        (10, "...!!! 123", "s2", "fr", "e", 2, "a", "x", "y"),
        (11, "nul \0 byte", "s2", "fr", "e", 3, "a", "x", "y"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
