import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _file string, _row int, print int, ids string, score string, _copy int"


def make(spark, rows):
    """Documents with columns of clashing names: (doc_id, text, lang, source)."""
    return spark.createDataFrame([(*r, 1, "f", 2, 3, "i", "s", 4) for r in rows], SCHEMA)


def prose(seed, words, letters="abcdefghij"):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(words))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and very long texts, copies, ties, repeated rows."""
    long = prose(1, 30_000)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "One two three.", "en", "b"),
        (5, "One two three.", "en", "b"), (5, "One two three.", "en", "b"), (None, "One two three.", "fr", None),
        (None, None, None, None), (6, long, "en", "a"), (7, long + " x", "en", "a"), (8, "é" * 100_000, "fr", "c"),
        (9, "###\n###\n|", "de", "c"), (10, "<|endoftext|> tail <|startoftext|>", "de", "c"), (11, "One  two three.", "en", "b"),
    ]
    rows += [(100 + i, prose(50 + i, 60), ("en", "fr")[i % 2], "abc"[i % 3]) for i in range(40)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return make(spark, edge_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return make(spark, [])
