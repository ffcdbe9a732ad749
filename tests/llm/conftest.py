import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"


@pytest.fixture(scope="session")
def docs(spark):
    """texts -> documents with ids 0, 1, … and extra columns whose names clash with results."""
    def build(texts):
        rows = [(i, t, "en", "s", len(t or ""), "x", None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)
    return build


