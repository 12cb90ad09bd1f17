import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, th string, k string, w string, row string, label string, d string, s_id string, t_id string, fp string, taken string, score string, y string"


def make(spark, rows):
    """Rows (doc_id, text, lang, source), with extra columns whose names operators might use themselves."""
    full = [(i, t, lang, src, None if t is None else len(t), *["x"] * 12) for i, t, lang, src in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, one word, a very long text, ties and repeated rows."""
    rng = random.Random(3)
    vocabulary = ["la", "mer", "THE", "sea", "über", "ñandú", "of", "a,", "b.", "token", "42"]
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    passage = " ".join(f"w{i}" for i in range(70))
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "word", "en", None), (5, long, "fr", "a"),
        (6, passage + " tail", "en", "b"), (7, "head " + passage, "en", "b"), (7, "head " + passage, "en", "b"), (8, passage, None, "b"),
        (None, passage, "de", "c"), (None, None, None, None), (9, long, "fr", "a"), (10, long + " more", "fr", "a"), (11, "1234 !!", "xx", "d"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return make(spark, odd_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
