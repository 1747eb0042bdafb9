import pytest

LONG = " ".join(f"word{i % 97}x{i % 89}" for i in range(9000))


@pytest.fixture
def awkward(spark):
    """Documents with null keys and texts, repeated rows, ties, long and empty texts, and
    columns named like results."""
    base = "the quick brown fox jumps over the lazy dog while seven green birds watch from a tall old tree nearby"
    texts = [
        (1, base), (2, base), (3, base + " and more"), (3, base + " and more"), (4, None), (5, ""), (6, " \n\t "),
        (None, base), (None, "short text"), (7, "Short text"), (8, LONG), (9, LONG + " end"), (10, "a"),
        (11, "é ß 日本 😀 " * 30), (12, "x\x1cy z\x0bw"), (12, "another text of the same key"),
    ]
    rows = [(k, t, 7, "n", True) for k, t in texts]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_words int, kept string, a boolean")
