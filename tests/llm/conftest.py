import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, fp long, size string, key int, rows int, score string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, source) with columns whose names clash with those inside the operators."""
    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, 7, "x", "y", 1, "z", 2, 3, "w") for i, t, s in rows], SCHEMA)
    return make


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    words = " ".join(f"word{i % 977}x{i % 13}" for i in range(12_000))
    return [(1, None, "a"), (2, "", "a"), (3, "  \n\t ", None), (4, words, "b"), (5, "one", "b"), (6, "one two", None),
            (7, "The cat sat on the mat. " * 20, "a"), (7, "The cat sat on the mat. " * 20, "a"), (None, "The cat sat on the mat. " * 20, "a"),
            (None, None, None), (8, "the CAT sat\x0bon the mat", "c"), (9, "x" * 8_000, "c"), (10, "é ü   ß", "c")]
