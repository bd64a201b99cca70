import pytest

TEXT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A maker of documents tables with odd extra columns."""

    def make(rows):
        full = [(i, t, l, "s", len(t or "")) for i, t, l in rows]
        docs = spark.createDataFrame(full, TEXT)
        return docs.selectExpr("*", "'x' AS n_words", "1 AS component_id", "0 AS window", "2 AS key")

    return make
