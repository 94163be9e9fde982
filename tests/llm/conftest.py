import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of documents tables from (doc_id, text) or longer rows."""

    def make(rows, extra=""):
        full = [(*r, *([None] * (5 - len(r)))) if len(r) < 5 else r for r in rows]
        return spark.createDataFrame(full, DOCUMENT + extra)

    return make
