import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, body string, klass string, label string"
LINE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def awkward():
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with names that operators use."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [
        (1, "Hello World again", "en", "a"), (2, "hello world AGAIN", "en", "a"), (3, "", "en", "b"), (4, None, None, None), (None, "hello world again", "fr", "b"),
        (5, "   \n\t ", "en", None), (6, "!!! ???", None, "b"), (7, long, "en", "a"), (8, long + " end", "en", "c"), (9, "x", "fr", "c"), (9, "x", "fr", "c"), (9, "x", "fr", "c"),
        (10, LINE, "en", "d"), (11, LINE.upper(), "en", "d"), (12, LINE + " phi", "en", "d"), (13, "ÉTÉ à la plage", "fr", "d"), (13, "another text with this id", "en", None), (None, None, None, None),
    ]
    return [(i, t, la, s, None if t is None else len(t), "r", "b", "k", "l") for i, t, la, s in rows]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 14)] + [(None, 1, 1), (99, None, None), (1, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
