import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside, as further columns of a table.
CLASHING = ("body", "name", "row", "words", "size", "score", "fp", "held_out", "copies", "hash", "kept", "trigger", "features")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHING})


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs, empty and long texts, repeated rows, one id with two texts."""
    long = "the quick brown fox and others " * 40_000
    rows = [
        (1, "Some words of a text. And some more words!", "en", "a", 1),
        (1, "Some words of a text. And some more words!", "en", "a", 1),
        (1, "Another text of the same id", "en", "b", 1),
        (2, None, None, None, None), (3, "", "en", "a", 0), (4, "   \n\t ", "en", "b", 1), (5, "12 34 -- !!", "en", "c", 1),
        (None, "A text without an id, long enough to share fifty bytes with some other text.", "en", "a", 1),
        (None, None, None, None, None),
        (6, long, "en", "a", len(long)), (7, long, "de", None, len(long)), (8, "x" * 300_000, None, "c", 300_000),
        (9, "A text without an id, long enough to share fifty bytes with some other text.", "fr", "d", 1),
        (10, "l'été à la plage   naïve \u0000 \U0001f600", "fr", "d", 1),
    ]
    return clashing(spark.createDataFrame(rows, COLUMNS).repartition(3))


@pytest.fixture(scope="session")
def nothing(spark):
    return clashing(spark.createDataFrame([], COLUMNS))


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i // 2) % 2) for i in range(1, 11)] + [(1, 1, 1), (None, 1, 1), (2, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").withColumn("label", F.lit("x"))
