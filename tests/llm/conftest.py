import pytest

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it all day"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from it all day"),
    (3, ""),
    (4, None),
    (None, "a row without an id has a text of its own here, that nobody else has at all"),
    (5, "wörter mit ümlauten und 日本語 sind auch dabei\nund eine zweite zeile."),
    (5, "wörter mit ümlauten und 日本語 sind auch dabei\nund eine zweite zeile."),
    (7, " ".join(f"w{i % 97}x{i % 13}" for i in range(30000))),
]
SCHEMA = "doc_id long, text string, source string, lang string, score double, idx long, ids string, spans int"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties and repeated rows, columns whose names clash with those of results."""
    return spark.createDataFrame([(i, t, f"s{k % 3}" if k % 4 else None, None, 1.0, 2, "x", 3) for k, (i, t) in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
