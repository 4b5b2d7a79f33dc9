import os

import pytest


@pytest.fixture(scope="session")
def small_sf():
    """The smallest supplied scale."""
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows from (doc_id, text) pairs, with extra columns whose names
    clash with those the operators add."""

    def make(pairs):
        return spark.createDataFrame(
            [(i, t, "en", "s", len(t) if t else None, "x", 1, "k") for i, t in pairs],
            "doc_id long, text string, lang string, source string, n_chars long, shard string, n_words int, kept string")

    return make


@pytest.fixture(scope="session")
def odd_texts():
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four five six seven eight nine ten eleven"),
            (6, "one two three four five six seven eight nine ten eleven"), (7, "Été ☃ \U0001f600 \x00 x" * 3),
            (8, "word " * 30000), (9, "a" * 20000), (5, "one two three four five six seven eight nine ten eleven"),
            (None, "a null key with some words in it"), (10, "it's we're don't  \n\n  x'll 123 4.5")]
