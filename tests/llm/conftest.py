import pytest

SF = "/root/testdata/sf0.01"

#: Nulls, empty and long texts, ties, repeated rows, and columns with names that operators use themselves.
ODD = [
    (1, "One two three four five six seven", "x", 1.0),
    (1, "One two three four five six seven", "x", 1.0),
    (None, "a null key", None, None),
    (2, None, "x", 2.0),
    (3, "", "y", 3.0),
    (4, "   \n\t ", "y", 4.0),
    (5, "one two three four five six seven", "z", 5.0),
    (6, "long " * 60_000, "z", 6.0),
    (None, None, None, None),
]


@pytest.fixture
def odd(spark):
    """Awkward rows under (doc_id, text, kept, score)."""
    return spark.createDataFrame(ODD, "doc_id long, text string, kept string, score double")


@pytest.fixture
def empty(odd):
    return odd.limit(0)
