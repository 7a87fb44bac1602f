import pytest

pytest.importorskip("snaplog.llm")

from llm_helpers import SCHEMA, frame, odd_texts  # noqa: E402


@pytest.fixture(scope="session")
def odd():
    return odd_texts()


@pytest.fixture(scope="session")
def odd_docs(spark, odd):
    return frame(spark, odd).cache()


@pytest.fixture(scope="session")
def repeated():
    """Rows that repeat, doc_ids that repeat with other texts, and null doc_ids."""
    text = "the same text stands here more than once and is longer than one hundred bytes so that it can be found again by all"
    return [(1, text, "a"), (1, text, "a"), (1, "another text of that id", "b"), (None, text, "a"), (None, None, None), (2, text, None), (2, text + " and more", "a"), (3, "", "a"), (3, "", "a")]


@pytest.fixture(scope="session")
def repeated_docs(spark, repeated):
    return frame(spark, repeated).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def small_texts(small_docs):
    return [(r["doc_id"], r["text"], r["source"]) for r in small_docs.collect()]
