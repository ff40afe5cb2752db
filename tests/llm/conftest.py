import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

# What every operator must bear: nulls in any column, empty, blank and very long
# texts, ties and repeated rows, one-word texts, letters beyond ASCII.
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n\r\x0b\x0c ", "en", "a", 7),
    (4, "one", "en", "b", 3),
    (5, "the quick brown fox " * 40, "en", "a", 800),
    (6, "the quick brown fox " * 40, "en", "a", 800),
    (6, "the quick brown fox " * 40, "en", "a", 800),
    (None, "the quick brown fox " * 40, "en", "a", 800),
    (None, None, None, None, None),
    (7, "word " * 30_000, "de", "b", 150_000),
    (8, "x" * 60_000, "de", "c", 60_000),
    (9, "été über naïve привет 世界 \U0001F600 " * 12, None, None, 5),
    (10, "THE QUICK brown fox " * 40, "en", "d", 800),
    (11, "no letters here: 12345"[17:], "fr", "", 5),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def medium(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def crowded(awkward):
    """The awkward rows with extra columns named like operators' own."""
    from pyspark.sql import functions as F
    names = ("size", "target", "copies", "score", "row", "s", "k", "of", "fp", "component_id", "rate", "kept", "n_words", "d", "t")
    return awkward.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
