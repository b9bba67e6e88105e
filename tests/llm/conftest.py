import random

import pytest

WORDS = "the of and a to in is that it was for on with as by at be this are or from an which but not have had they you were".split()


@pytest.fixture(scope="session")
def prose():
    """Deterministic prose: prose(seed, words)."""

    def make(seed: int, words: int = 80) -> str:
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) if r.random() < 0.4 else "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 9))) for _ in range(words))

    return make


ODD = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, node string, place string, bucket int"


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Nulls in every column, empty, blank and long texts, repeated rows, and columns that clash."""
    from tracklake.llm.common import ship

    ship(spark)
    p, q = prose(1), prose(2)
    rows = [
        (1, p, "en", "a", 5, 1, "x", "y", "z", 0),
        (1, p, "en", "a", 5, 1, "x", "y", "z", 0),
        (2, p, "en", "a", None, None, None, None, None, None),
        (None, p, None, None, None, 2, "x", "y", "z", 0),
        (None, None, None, None, None, None, None, None, None, None),
        (3, None, "en", "a", 0, 1, "x", "y", "z", 0),
        (4, "", "en", None, 0, 1, "x", "y", "z", 0),
        (5, " \n\t\n  ", None, "a", 0, 1, "x", "y", "z", 0),
        (6, q + "\n" + q.replace("the", "The", 1), "en", "b", 9, 1, "x", "y", "z", 0),
        (7, "word " * 30000, "en", "b", 9, 1, "x", "y", "z", 0),
        (8, "x" * 60000, "en", "b", 9, 1, "x", "y", "z", 0),
        (9, "one two", "de", "b", 9, 1, "x", "y", "z", 0),
        (10, "One TWO", "de", "b", 9, 1, "x", "y", "z", 0),
        (11, prose(3, 9000), "fr", "c", 9, 1, "x", "y", "z", 0),
    ]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)
