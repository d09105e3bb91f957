import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size string, score string, h long, n long, row string"
WORDS = "the of and river stone walks under seven quiet lamps near old harbour while children count passing ships again".split()


def prose(seed, words):
    r = random.Random(seed)
    out = []
    for i in range(words):
        w = r.choice(WORDS) + str(r.randint(0, 99) if r.random() < 0.02 else "")
        out.append(w + (r.choice([".", ".", ",", "\n"]) if r.random() < 0.15 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, clashing names."""
    long_ = prose(1, 250_000)
    rows = [(1, prose(2, 200), "en", "a"), (2, prose(2, 200), "en", "a"), (2, prose(2, 200), "en", "a"),
            (3, None, None, None), (4, "", "en", None), (5, " \n\t ", None, "b"), (None, prose(2, 200), "en", "b"),
            (None, None, None, None), (6, long_, "en", "b"), (7, long_.upper(), None, "c"), (8, "1234 5678 --", "en", "c"),
            (9, "ä", "de", "c"), (10, "a\n" * 3000, "en", "c"), (11, "x" * 5000, None, "d")]
    return spark.createDataFrame([(*r, 0, None, "x", None, 5, 6, "z") for r in rows], SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
