"""Building the index: what is counted, and that only texts are shuffled for it."""

from __future__ import annotations

from collections import Counter

from linkloom.functions.text import query_tokens
from linkloom.operators import blockmax, fulltext
from linkloom.session import stage
from tests.helpers import table

FIELDS = ("title", "summary", "keywords", "notes", "url")
ROWS = [
    {"url": f"https://e.org/{i}", "title": "Spark spark café" if i % 3 else "", "summary": "a bb a " * (i % 5) + "internationalization", "notes": None if i % 2 else "x-x"}
    for i in range(40)
]


def exchanges(df):
    """Shuffles in the plan of a DataFrame."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def plain_postings(rows):
    found = Counter()
    for r in rows:
        for field in FIELDS:
            for term in query_tokens(r.get(field) or ""):
                found[(term, r["url"], field)] += 1
    return found


def test_postings_are_counted_within_rows(spark):
    stored = table(spark, *ROWS)
    urls = {r.id: r.url for r in stored.collect()}
    rows = fulltext.postings(stored)
    assert exchanges(rows) == 1  # texts by id; words by id were shuffled once more than that
    assert "HashAggregate" not in rows._jdf.queryExecution().executedPlan().toString().replace("ObjectHashAggregate", "")
    assert {(r.term, urls[r.id], r.field): r.tf for r in rows.collect()} == dict(plain_postings(ROWS))


def test_rows_of_a_repeated_id_are_counted_together(spark):
    rows = fulltext.postings(table(spark, ROWS[1], ROWS[1], ROWS[2])).collect()
    assert len(rows) == len({(r.term, r.id, r.field) for r in rows})
    assert {r.tf for r in rows if r.term == "cafe"} == {1, 2}


def test_prefixes_are_counted_where_their_block_lies(spark, monkeypatch):
    monkeypatch.setattr(blockmax, "TASK_TOKENS", 50)
    tokens = stage(blockmax.block_tokens(table(spark, *ROWS), 8), "tokens")
    found = blockmax.prefix_blocks(tokens)
    assert exchanges(found) == 1  # texts by block; prefixes by row, and by block, were shuffled before
    want: dict = {}
    for r in tokens.collect():
        words = [w for f in FIELDS for w in (r[f] or "").split()]
        freqs = Counter(w[:n] for w in words for n in range(1, min(len(w), blockmax.PREFIX_CHARS) + 1))
        for prefix, freq in freqs.items():
            n, most, short = want.get((prefix, r.block), (0, 0, 1 << 30))
            want[prefix, r.block] = (n + 1, max(most, freq), min(short, r.length))
    assert {(r.prefix, r.block): (r.rows, r.max_freq, r.min_length) for r in found.collect()} == want


def test_an_empty_catalog_has_an_empty_index(spark):
    tokens = stage(blockmax.block_tokens(table(spark), 8), "tokens")
    assert blockmax.prefix_blocks(tokens).count() == 0 and blockmax.block_postings(tokens).count() == 0
