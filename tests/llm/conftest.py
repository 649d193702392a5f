import pytest

#: Null and empty texts, a repeated row, a null id, odd white space, and a column that the operators name themselves.
SCHEMA = "doc_id long, text string, lang string, source string, score double, row string, tokens int"


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en" if i is None or i % 2 else "fr", "s0" if i is None or i % 3 else "s1", 1.0, "x", 7) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(frame):
    base = " ".join(f"word{i}" for i in range(60))
    return frame([(1, None), (2, ""), (3, " \t\n"), (4, base), (4, base), (None, base + " tail"), (5, "a b"), (6, "…!? 12"), (7, "x " * 5000), (8, base.upper())])


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])
