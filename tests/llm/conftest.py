import pytest

ODD = [
    (1, "Same text here, with a few words in it.", "a", 1.0),
    (2, "SAME text here, with a few words in it.", "a", 2.0),
    (3, None, "a", 3.0),
    (4, "", None, 4.0),
    (5, " \n\t ", "b", 5.0),
    (6, "word " * 30_000, "b", 6.0),
    (7, "Une phrase été à l'école. Ça va? Oui!\n\nSecond part.", "b", 7.0),
    (8, "Une phrase été à l'école. Ça va? Oui!\n\nSecond part.", None, 8.0),
    (None, "a text without an identifier", "c", None),
    (2**53 + 1, "x" * 50_000, "c", 9.0),
    (10, "\U0001F600 emoji and \x1c control", "c", 0.0),
]
SCHEMA = "doc_id long, text string, source string, digest double"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeats, and a column that clashes with a name used inside."""
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
