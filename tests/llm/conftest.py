import random

import pytest


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def odd(spark):
    """Rows that operators must stand: nulls, empty and blank texts, ties, repeated rows, clashing columns."""
    rows = [(1, None, "x"), (2, "", None), (3, " \t\n ", "y"), (4, "One two", "z"), (4, "One two", "z"), (None, "One two", None), (None, None, None), (5, "A long text of some words that go on and on. " * 40, "w")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string")
