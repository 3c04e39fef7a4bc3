import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    prose = " ".join(f"term{i}" for i in range(120))
    rows = [
        (1, prose, "en", "a"), (2, prose, "en", "a"), (2, prose, "en", "a"), (3, prose.upper(), "de", "b"), (4, None, None, None),
        (5, "", "en", "a"), (None, "only two", None, "b"), (None, None, "fr", None), (6, " \t\n ", "en", "a"), (7, long, "en", "a"),
        (8, prose + " one more word", "en", "b"), (9, "naïve café\nnaïve café\n漢字 😀", "fr", "b"), (None, prose, "en", None),
    ]
    cells = [(*r, 1, "k", 2, "x", 3) for r in rows]
    names = ["doc_id", "text", "lang", "source", "node", "key", "id", "row_no", "v_id"]
    return spark.createDataFrame(cells, "doc_id long, text string, lang string, source string, node int, key string, id int, row_no string, v_id int").select(*names)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
