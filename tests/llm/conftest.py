import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty, short, long, tied and repeated texts, and columns whose names might clash."""

    def make(texts, ids=None, **more):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s", 0, 1.5, "x") for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, part string")

    return make
