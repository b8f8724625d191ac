import pytest


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, empty and long texts, repeated rows, ties, and columns whose names clash with the operators' own."""
    long = " ".join(f"word{i} the" for i in range(30_000))
    rows = [(1, "the cat sat on the mat. " * 3, "en", "a"), (1, "the cat sat on the mat. " * 3, "en", "a"), (2, None, None, None), (3, "", "en", "b"), (4, long, "en", "a"), (None, "a null id", None, "b"), (5, " \n\t ", "en", None), (6, "日本語 ünïcode 🦊\x00", "xx", "c"), (7, "a b", "en", "c")]
    return spark.createDataFrame([(*r, "x", 0, 0, "k") for r in rows], "doc_id long, text string, lang string, source string, score string, n_words int, size int, id string")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
