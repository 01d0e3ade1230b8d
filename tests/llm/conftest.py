import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, target double, start long"


@pytest.fixture(scope="session")
def ship(spark):
    from halyard.llm.common import ship

    ship(spark)
    return spark


@pytest.fixture(scope="session")
def make(ship):
    """A documents table with clashing extra columns, of (doc_id, text, lang, source)."""

    def build(rows):
        return ship.createDataFrame([(i, t, lang, src, len(t or ""), "x", 0.5, 7) for i, t, lang, src in rows], DOCS)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in all columns, empty and blank texts, repeated rows, a very long text."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return make([(1, "a b c d e", "en", "s1"), (1, "a b c d e", "en", "s1"), (2, None, None, None), (None, "a b c d e", "en", None), (3, "", "de", "s2"), (4, " \t\n", "de", "s2"), (5, long, "en", "s1"), (6, "Ünï cödé \U0001f600 x", "de", "s3"), (None, None, None, None)])
