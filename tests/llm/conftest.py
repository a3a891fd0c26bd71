import zlib

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def small():
    return SMALL


def fold_of(doc_id, n):
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    passage = "the quick brown fox jumps over the lazy dog while seventeen other animals look on and wonder about the purpose of it all, " * 3
    rows = [
        (1, passage + "one", "en", "a"), (2, passage + "two", "en", "a"), (2, passage + "two", "en", "a"),
        (3, None, None, None), (4, "", "en", "b"), (None, "a text without an id " * 20, None, "b"), (None, None, "fr", None),
        (5, " \t\n ", "en", "b"), (6, "aaaa" * 400, "en", "a"), (7, "word " * 30000, "en", "a"), (8, "é" * 150 + passage, "fr", "a"),
        (9, "Straße İstanbul \x00 nul   sep", "de", "c"), (10, passage.upper(), "en", "c"),
    ]
    df = spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", 2.0, 5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, key string, score double, fp int")
    return df.repartition(3)
