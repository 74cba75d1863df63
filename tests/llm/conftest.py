import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, fp int, th int"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text) rows, with columns whose names clash with internal ones."""
    def made(rows):
        return spark.createDataFrame([(i, t, "en", None, None, "x", 1, None) for i, t in rows], SCHEMA)

    return made


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, very long and repeated rows, ties."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "Delta,", "é́é", "ñandú", "10.0.0.1", "a@b.co", "日本語", "😀"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "One  two\x0b"), (6, "One  two\x0b"),
        (None, "no id here"), (7, long), (8, long), (9, "x" * 50_000), (10, "1" * 20_000), (11, "a." * 8_000), (None, None),
        (12, "O\x0cNE"), (13, "ONE"), (14, "1.1." * 5000), (15, "+1 " * 6000), (16, "a@b" * 5000),
    ]
