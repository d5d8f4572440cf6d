"""Answers found by text: whole rows are written once, and a model sees each text once wherever it lies."""

from __future__ import annotations

import pytest

from linkloom.operators import answers, skew
from linkloom.operators.answers import AnswerBook
from linkloom.plans import enrich
from linkloom.sources.tables import TableStore, default_tables
from linkloom.session import scratch_path
from tests.helpers import T0, by, table


@pytest.mark.parametrize("few_keys", [1000, 0])
def test_texts_are_written_once_for_all_models(spark, monkeypatch, few_keys):
    monkeypatch.setattr(skew, "FEW_KEYS", few_keys)
    written, stage = [], answers.stage
    for module in (answers, enrich):
        monkeypatch.setattr(module, "stage", lambda df, name: written.append(df.columns) or stage(df, name))
    contents = ["One text. More", "One text. More", "another text", "", "has a summary"]
    given = [{"url": f"https://e.org/{i}", "title": "same", "raw_content": c, "summary": "kept" * (i == 4)} for i, c in enumerate(contents)]
    rows = table(spark, *given)
    crawl = spark.createDataFrame([("https://none", "x", 1)], "url string, content string, seq int")
    book = AnswerBook(TableStore(spark, scratch_path(spark, "test-store"), default_tables(2)).empty("answers"))
    got = by(enrich.enrich_rows(rows, T0, crawl, book=book))
    assert sum("raw_content" in columns for columns in written) == 1
    assert not any({"_prompt", "_text"} & {*columns} for columns in written)
    assert book.calls == {"lead": 2, "hash": 3}
    assert book.additions().count() == 5
    want = by(enrich.enrich_rows(rows, T0, crawl))
    assert got == want and want["https://e.org/3"]["embedding"] is None
    book = AnswerBook(book.additions())
    assert by(enrich.enrich_rows(rows, T0, crawl, book=book)) == want and book.calls == {"lead": 0, "hash": 0}
