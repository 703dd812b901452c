import pytest


@pytest.fixture(scope="session")
def table(spark):
    """Documents from texts: ids from 0 on, and columns whose names clash with the operators'."""

    def make(texts, ids=None):
        rows = [(i, t, "en", "s", 0, "x", 1) for i, t in zip(ids if ids is not None else range(len(texts)), texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, n int")

    return make


EDGES = [None, "", " ", "a", "a", "\n\n", "é中💥 'll it's", "word " * 3000, "x" * 20000, "The cat sat. The dog ran! Is it so? Yes.\nOh.", "<|endoftext|> b", "A B C D E F"]


@pytest.fixture
def edges():
    return list(EDGES)
