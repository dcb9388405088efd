import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def documents(spark):
    """Makes a documents table, with columns whose names operators use themselves."""

    def make(rows):
        full = [(k, t, "en", s, None if t is None else len(t)) for k, t, s in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture()
def odd(documents):
    """Nulls, empty and long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 977}" for i in range(30000))
    return documents([(1, "a b c", "s"), (1, "a b c", "s"), (2, "", None), (3, None, "s"), (None, "a b c", None), (None, None, None), (4, long, "t"), (5, "x" * 5000, "t"), (6, " \n\t ", "t")])
