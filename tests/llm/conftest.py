import random

import pytest

DOCUMENTS = "doc_id long, text string, source string, score double, row string, kept string, length long, part long, rep long, comp long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with columns whose names clash with those the operators use."""

    def make(rows):
        return spark.createDataFrame([(i, t, "src", 0.1, "r", "k", 7, 1, 2, 3) for i, t in rows], DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, white space only, a very long text, repeated rows, a null id, odd characters."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "été", "日本", "x1", "it's"]
    long = " ".join(rng.choice(words) + str(rng.randrange(500)) for _ in range(30_000))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, long), (5, long + " tail"), (6, "one"), (7, "one"), (7, "one"),
        (None, "no id here"), (8, "<|endoftext|> a  b \x1c c d"), (9, "A b c d e f g h i j k l"),
        (10, "a B c d e f g h i j k l"),
    ]


@pytest.fixture()
def odd(documents, odd_rows):
    return documents(odd_rows)


@pytest.fixture()
def nothing(documents):
    return documents([])
