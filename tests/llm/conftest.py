import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a table of documents from (doc_id, text) with clashing extra columns."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        extra = "rule string, length long, component_id string, line string, n_words string"
        return spark.createDataFrame([(*r, "x", 1, "c", "l", "n") for r in full], f"{DOCS}, {extra}")

    return make
