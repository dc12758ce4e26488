import pytest

DOCS = "doc_id long, text string, lang string, id long, n string"


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and texts, empty, blank, long and repeated rows, columns named like the operators' own."""
    words = " ".join(f"w{i % 97}x{i % 13}" for i in range(3000))
    rows = [(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, " \n\t "), (None, "the quick brown fox"), (None, None), (5, "x"), (6, words), (6, words), (7, "ünï cödé 日本語 𝒳 words"), (8, "a" * 50_000), (9, words + " tail")]
    return spark.createDataFrame([(i, t, "en", 0, "x") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
