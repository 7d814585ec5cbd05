import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with nulls everywhere, empty and very long texts, repeats, clashing columns."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf today in the deep dark wood"
    rows = [
        (1, base, "en", "a", 10), (2, base, "en", "a", 10), (2, base, "en", "a", 10), (3, base.replace(" ", "\t "), None, None, None),
        (4, None, "en", "b", 0), (5, "", "en", "b", 0), (6, " \n\t ", "en", "b", 0), (7, LONG, "en", "c", 1), (8, LONG + "end", "en", "c", 1),
        (9, base + " indeed", "en", None, 1), (None, "a text without an id", "en", "a", 1), (10, "one two", "de", "b", 2), (11, "ONE TWO", "de", "b", 2),
        (12, "Under the MIT License; cc by-nc and under the mit license", "en", "a", 3), (13, "é ß <|endoftext|> \u00a0 x", "fr", "a", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clashes = ["score", "sha", "keep_id", "group_size", "kept", "token", "n", "block", "size", "taken", "part", "seq", "payload", "start", "_id", "i", "t"]
    return df.withColumns({c: F.lit("x") for c in clashes})


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.where("false")
