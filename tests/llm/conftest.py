import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_llm import SMALL  # noqa: E402

ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "a b c d e f g"), (5, "a b c d e f g"), (None, "row without an id"),
    (7, "x" * 200_000), (8, "word " * 30_000), (9, "\x1c\x1d é ß 中文 🙂 ́ İΣς"), (10, "line\nline\nline\n\nother | # $"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names that operators might use themselves."""
    rows = [(i, t, 1, "z", [1], "k", 0.5, True) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, id string, spans array<int>, key string, score double, kept boolean")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}
