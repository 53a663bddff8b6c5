import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs."""

    def make(pairs):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, an id with two texts, and columns with the operators' own names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000)) + "\n" + "line of words " * 40
    rows = [(None, "text without id"), (1, None), (None, None), (2, ""), (3, "   \n \n"), (4, "one"), (5, long), (5, long), (6, long), (7, "é́ — “quoted” \U0001f600 text"), (8, "same id"), (8, "other text"), (9, "a\n" * 300)]
    return spark.createDataFrame(
        [(i, t, None, None, None, "x", 1, 2, "y", 3) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, th string, pos long, h long, line string, whole long",
    )


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([])
