import pytest

#: Schema of a documents table with columns whose names clash with those of results.
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row bigint, size bigint, node string, kept string"


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) pairs, with clashing extra columns."""

    def make(rows, lang=None, source=None):
        data = [(i, t, lang, source, len(t or ""), 5, 6, "x", "y") for i, t in rows]
        return spark.createDataFrame(data, DOCS)

    return make
