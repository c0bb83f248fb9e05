import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(["an", "er", "th", "é", "ou", "ti", "on"]) for _ in range(r.randint(1, 4))) for _ in range(200)]
    return " ".join(r.choice(words) + r.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    def rows(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)

    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    texts = [None, "", " \t\n ", "one", "One two", prose(1, 60), prose(1, 60), prose(1, 59) + " zz", prose(2, 60_000), "x" * 70_000, "a b " * 3_000, "\x00\x1f\x85 ퟿ 😀 é"]
    rows = [(i, t, 1, "h", i, "w") for i, t in enumerate(texts)] + [(5, texts[5], 1, "h", 5, "w"), (None, texts[5], None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, key int, h string, fp long, word string").repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
