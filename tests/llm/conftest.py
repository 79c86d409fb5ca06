import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents from texts, or from rows (doc_id, text, lang)."""

    def make(texts, lang="en"):
        rows = [t if isinstance(t, tuple) else (k, t, lang) for k, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, c, "s", len(t or "")) for i, t, c in rows], DOCS)

    return make
