import pyarrow.parquet as pq
import pytest


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(sf):
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    return {r["doc_id"]: r["text"] for r in rows}


LONG = "all sorts of words and then some more " * 3000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, shared ids, and columns whose names operators use themselves."""
    rows = [
        (1, "plain words in a row, nothing else here", "en", "a"), (1, "plain words in a row, nothing else here", "en", "a"), (2, None, None, None), (None, "no id but words", "en", None), (3, "", "en", "b"),
        (4, LONG, "en", "b"), (5, "   \n\t ", None, "b"), (None, None, None, None), (6, "wörter ohne sinn und verstand", "de", ""), (2, "the same id with another text", "en", "a"), (7, "12345 !!! ###", "de", "a"),
    ]
    clash = [(*r, 0, 0.5, "x", None, 1, 2, 3, 4) for r in rows]
    return spark.createDataFrame(clash, "doc_id long, text string, lang string, source string, n_chars int, score double, fp string, root string, size int, row int, rank int, word int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
