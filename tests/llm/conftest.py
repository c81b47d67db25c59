import random

import pytest


@pytest.fixture(scope="session")
def rng():
    return random.Random(7)


@pytest.fixture(scope="session")
def words(rng):
    """Invented words, rare ones included."""
    return ["".join(rng.choice("abcdeghilmnoprstuéñß") for _ in range(rng.randint(2, 8))) for _ in range(3000)]


DOC_DDL = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def make_docs(spark, texts, sources=("a", "b", None)):
    """Documents with an extra column whose name the operators also use."""
    rows = [(i, t, "en", sources[i % len(sources)], None if t is None else len(t), "extra")
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_DDL)


@pytest.fixture(scope="session")
def docs_of(spark):
    return lambda texts, **options: make_docs(spark, texts, **options)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, and repeated rows."""
    long_text = "long tail of words " * 20_000
    rows = [(1, None, None, None, None, None), (2, "", "en", "a", 0, "x"), (None, "no id at all", "en", "a", 12, "x"),
            (3, "same row", "en", "b", 8, "x"), (3, "same row", "en", "b", 8, "x"), (4, long_text, "en", None, None, "x"),
            (None, None, None, None, None, None), (5, " \t\n ", "de", "b", 4, "x"), (6, long_text, "en", "a", 1, "x")]
    return spark.createDataFrame(rows, DOC_DDL)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_DDL)
