import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    base = "the quick brown fox of the north and a lazy dog in the south went to see that it is for you and me today"
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, base, "x", 1), (2, base.upper(), "x", 1), (3, base + " again", None, 2), (4, None, "y", 3), (5, "", "y", 4),
            (6, long, "z", 5), (7, long + " tail", "z", 6), (8, "one", "z", 7), (9, "One", "z", 8), (10, " \t\n ", "z", 9),
            (1, base, "x", 1), (None, "null id text", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, rank string, n_words long")
