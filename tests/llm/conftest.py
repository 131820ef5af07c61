import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, start string, ids string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts, with further columns whose names operators use themselves."""

    def make(texts, first=0):
        rows = [(first + i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def parquet_of(docs_of, spark, tmp_path_factory):
    """The same as a table read from files."""

    def make(texts, first=0):
        path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
        docs_of(texts, first).write.parquet(path)
        return spark.read.parquet(path)

    return make


EDGES = [None, "", " ", "a", "a b", "one two three", "é ß 日本", "word " * 30_000]


@pytest.fixture(scope="session")
def edges():
    """Null, empty, tiny, odd and very long texts, one of them twice."""
    return [*EDGES, "one two three"]
