import pytest

from dispatchlens.llm import common

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def workers_find_the_package(spark):
    common.importable(spark)


@pytest.fixture
def documents(spark):
    """Makes a documents table of (doc_id, text) pairs with columns whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1.5, "x", 7) for i, t in rows], DOCS + ", score double, kept string, salt long")

    return make
