"""Fixtures that the tests of this folder import by name."""

import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A table of documents, with further columns whose names the operators use too, in a few partitions."""

    def make(rows):
        full = [(i, t, "en" if t else None, None, None if t is None else len(t), None, "x") for i, t in rows]
        return spark.createDataFrame(full, DOC_SCHEMA).repartition(3)

    return make


@pytest.fixture
def edge_rows():
    """Nulls, empty, blank, wordless, repeated rows, a tie of texts, a long text."""
    long_text = "stone river " * 9000 + "x" * 3000
    return [(1, None), (2, ""), (3, "   \n"), (4, "!!! ..."), (5, "same words here"), (5, "same words here"), (None, "same words here"), (None, None), (6, "Same words here"), (7, long_text), (8, "é漢字😀" * 50)]
