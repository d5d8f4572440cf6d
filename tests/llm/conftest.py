from __future__ import annotations

import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null, empty, blank and very long texts, repeated rows, null keys, and extra columns with clashing names."""
    long_text = "word " * 60_000 + "end"
    rows = [
        (1, None, None, "a", 1), (2, "", "en", "a", 2), (3, " \t\n", "en", None, 3), (4, long_text, "en", "a", 4),
        (5, "The same line of text stands here.\nOther words follow it now.", "en", "b", 5),
        (5, "The same line of text stands here.\nOther words follow it now.", "en", "b", 5),
        (6, "The same line of text stands here.", None, "b", 6), (None, "12 34", "fr", None, 7), (7, "x" * 50_000, "fr", "c", 8),
    ]
    schema = "doc_id long, text string, lang string, source string, score int"
    return spark.createDataFrame(rows, schema).selectExpr("*", "1 AS size", "'k' AS fp", "2 AS n_lines", "'z' AS lang_pred", "0 AS row")
