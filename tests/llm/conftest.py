import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows (doc_id, text, lang, source) as a table in a few partitions, with a column that clashes with results."""
    def make(rows, parts=3):
        full = [(*r, *[None] * (4 - len(r)), 7) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_words int").repartition(parts)
    return make


AWKWARD = [(1, None), (2, ""), (3, " \n\t"), (None, "a null id has words too. It has two."), (5, "same row"), (5, "same row"),
           (6, "x" * 200_000), (7, "wörter " * 30_000), (8, "!"), (9, " ▁  "), (10, "1. 2. 3.")]


@pytest.fixture(scope="session")
def awkward(docs):
    """Nulls in every column, empty, blank and very long texts, a repeated row."""
    return docs([(i, t, "en" if i and i % 2 else None, "s" if i and i % 3 else None) for i, t in AWKWARD])


@pytest.fixture(scope="session")
def empty(docs):
    return docs([(1, "x")]).filter("doc_id < 0")
