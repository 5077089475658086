"""Documents with every oddity that the operators must take: nulls, empty and long texts, repeated rows, clashing names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, hash string, row long, id long, key string, n long, token string"
CLASH = (True, "h", 1, 2, "k", 3, "t")

PROSE = "the quick brown fox jumps over the lazy dog and runs away from all the noise of the town"


def _row(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text or ""), *CLASH)


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [
        _row(1, PROSE),
        _row(2, PROSE),
        _row(2, PROSE),
        _row(3, None),
        _row(4, ""),
        _row(5, " \n\t "),
        _row(6, "word", None, None),
        _row(7, "word " * 50_000),
        _row(8, PROSE + " today", "en"),
        _row(None, PROSE, None, None),
        (9, "Ünïcode tëxt ☃ 12345", None, None, None, None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs_small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
