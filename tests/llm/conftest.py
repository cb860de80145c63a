import pytest

LONG = "lorem ipsum dolor sit amet " * 9000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, equal texts, and extra columns with names that operators use."""
    rows = [
        (1, None, "en", "a.org", 0), (2, "", None, None, 0), (3, "x", "en", "a.org", 1), (4, LONG, "en", "b.org/p", 1), (5, "Guten Tag, wie geht es dir?", "de", "a.org", 1),
        (5, "Guten Tag, wie geht es dir?", "de", "a.org", 1), (6, "Guten Tag, wie geht es dir?", "de", "b.org", None), (None, "no id here at all", "en", "c.org", 1), (None, None, None, None, None),
        (8, "1234 !!! ???", "en", "c.org", 0), (9, "\u2581 a\x00b \U0001f642 e\u0301", "fr", "c.org", 1),
    ]
    rows = [(*r, "extra", 7, "clash", 1.5, b"x") for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, row int, found string, score double, media binary")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id > 100")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}
