import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty and repeated texts, an extra column, and names that clash with results."""
    rows = [
        (1, "Hello World foo bar baz qux", "en", "a", 3), (2, None, None, None, None), (3, "", "en", "a", 0), (4, "Hello World foo bar baz qux", "en", "b", 3),
        (None, "x y z", "en", "b", 1), (5, "long " * 30_000, "de", "a", 1), (4, "Hello World foo bar baz qux", "en", "b", 3), (6, "\n\n", "fr", "c", 2),
    ]
    return spark.createDataFrame([(*r, "extra", 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, tokens double")
