import pytest


@pytest.fixture
def frame(spark):
    """A table of documents from (doc_id, text) rows, with the columns of documents."""

    def make(rows, extra=""):
        data = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long" + extra)

    return make
