import pytest

from srcmetrics.llm.store import ship

LONG = "word%d " * 3 % (1, 2, 3) * 30_000
#: (doc_id, text, lang, source, n_chars): nulls, empty and long texts, repeated rows and ties.
EDGES = [
    (1, "The quick brown fox jumps over the lazy dog near the old mill.", "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog near the old mill.", "en", "a", 1),
    (2, "The quick brown fox jumps over the lazy dog near the old mill.", "en", "a", 1),
    (3, None, None, None, None),
    (4, "", "en", "b", 0),
    (5, " \n\t ", "de", "b", 4),
    (6, "12 34 !!", None, "c", 8),
    (7, LONG, "en", "c", len(LONG)),
    (8, LONG, "en", None, len(LONG)),
    (9, "one", "en", "a", 3),
    (10, "éà ü\nline\n\nline\U0001f600", "fr", "é", 9),
    (None, "no id here at all", "en", "a", 5),
    (None, None, None, None, None),
]
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def llm(spark):
    return ship(spark)


@pytest.fixture(scope="session")
def edges(llm):
    """The edge cases, with further columns whose names operators use themselves."""
    rows = [(*r, "x", 1, 2, 3, "y") for r in EDGES]
    more = ", size string, shard int, block int, component_id int, taken string"
    return llm.createDataFrame(rows, KIND + more).repartition(3)


@pytest.fixture(scope="session")
def nothing(llm):
    return llm.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def docs(llm):
    return llm.createDataFrame
