import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} tail{i % 31}." for i in range(20_000))


@pytest.fixture(scope="session")
def shipped(spark):
    from ledgerlark.llm.common import ship

    ship(spark)
    return spark


@pytest.fixture(scope="session")
def documents(shipped):
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    return shipped.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}


@pytest.fixture(scope="session")
def odd(shipped):
    """Nulls everywhere, empty and very long texts, ties, repeated rows, and columns named like results."""
    rows = [(1, None, None, None, 5), (2, "", "a", "en", None), (3, "  \n\t ", "a", "en", 5), (4, LONG, "a", "de", 5), (5, LONG, "b", None, 5), (6, "One two three. " * 40, "b", "en", 5),
            (6, "One two three. " * 40, "b", "en", 5), (None, "no id here at all", "a", "en", 5), (8, "x", "b", "en", 5), (9, "Ünï çödé ☃ 漢字 <|endoftext|>", "b", "en", 5)]
    return shipped.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept int").selectExpr("*", "1 AS spans", "2 AS copy", "3 AS component_id", "4 AS node", "5 AS rank", "6 AS host")
