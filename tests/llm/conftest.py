import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of (doc_id, text) as a documents table with extra columns whose names clash with those of operators."""

    def make(rows, lang="en"):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else lang, "s", len(r[1] or ""), 1, "x", 2) for r in rows]
        return spark.createDataFrame(rows, DOCUMENTS + ", n int, key string, pos int").repartition(3)

    return make
