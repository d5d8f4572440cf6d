"""Merges of stored tables: texts travel once, and rows that do not change are written where they are read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from linkloom.checks import ingest
from linkloom.operators import catalog, skew
from linkloom.plans import index
from linkloom.plans import sync as jobs
from linkloom.session import scratch_path
from linkloom.sources import feeds
from linkloom.sources.tables import Parts, TableStore, default_tables
from tests.helpers import T0, at, by, table

T1 = "2024-06-02 12:00:00"


def stored(spark):
    store = TableStore(spark, scratch_path(spark, "test-store"), default_tables(3))
    rows = [{"url": f"https://e.org/{i}", "title": f"title {i}", "summary": "alpha beta " * i, "scrape_status": ["success", "pending"][i % 2]} for i in range(12)]
    store.commit("rows", {"bookmarks": table(spark, *rows)})
    return store


@pytest.mark.parametrize("blank_is_null", [True, False])
def test_dealt_upsert_is_the_upsert(spark, blank_is_null):
    store = stored(spark)
    news = [{"url": f"https://e.org/{i}", "title": f"new {i}", "summary": "", "created_at": at("2024-03-01")} for i in (3, 4, 20)]
    incoming = table(spark, *news).withColumn("seq", F.monotonically_increasing_id())
    batch = catalog.collapse_batch(incoming, ["seq"], blank_is_null)
    have = store.read("bookmarks")
    want = catalog.upsert(have, batch, T1, blank_is_null).select(*have.columns)
    dealt, merge = catalog.dealt_upsert(have, batch, T1, blank_is_null)
    written = store.prepare("bookmarks", Parts(None, dealt, merge))
    assert by(written.rows, "id") == by(want, "id")
    assert store.read("bookmarks").count() == 12  # nothing of it is visible yet


@pytest.mark.parametrize("few_keys", [1000, 0])
def test_index_follows_whether_keys_are_few_or_not(spark, monkeypatch, few_keys):
    monkeypatch.setattr(skew, "FEW_KEYS", few_keys)
    store = stored(spark)
    index.build_index(store, "i")
    rows = store.read("bookmarks")
    late = table(spark, {"url": "https://e.org/2", "title": "second gamma"}, {"url": "https://e.org/30", "title": "gamma"})
    placed = late.withColumns({"source_order": F.lit(0), "page_no": F.lit(0), "pos": F.xxhash64("url")})
    marks = spark.createDataFrame([], "feed string, mark timestamp")
    result = jobs.publish(store, list(feeds.FEEDS.values()), placed, marks, T0, "late")
    assert (result.new_items, [tuple(r) for r in result.stats.collect()]) == (1, [("github", 1, 1)])
    first = rows.filter("url IN ('https://e.org/1', 'https://e.org/2')").select("id")
    jobs.edit(store, first.withColumn("summary", F.lit("delta")), T1, "edit")
    jobs.remove(store, rows.filter("url IN ('https://e.org/5', 'https://e.org/2')").select("id"), "remove")
    assert jobs.remove(store, first, "remove") == store.snapshot().version
    now = by(store.read("bookmarks"))
    assert sorted(now) == sorted(f"https://e.org/{i}" for i in (0, 1, 3, 4, 6, 7, 8, 9, 10, 11, 30))
    assert (now["https://e.org/1"]["title"], now["https://e.org/1"]["summary"]) == ("title 1", "delta")
    terms = ["term", "id", "field", "tf", "length"]
    want = sorted(index.index_rows(store.read("bookmarks")).select(*terms).collect())
    assert sorted(index.open_index(store)[0].select(*terms).collect()) == want
    stats = index.open_index(store)[1].first()
    lengths = by(store.read("doc_lengths"), "id")
    assert stats.n == 11 == len(lengths) and stats.mean_length == pytest.approx(sum(r["length"] for r in lengths.values()) / 11)


def test_rows_that_stay_are_written_where_they_are_read(spark):
    store = stored(spark)
    index.build_index(store, "i")
    jobs.edit(store, store.read("bookmarks").select("id", F.lit("x").alias("summary")), T1, "edit")
    ids = store.read("bookmarks").limit(3).select("id")
    for name in ("bookmarks", "postings_recent"):
        kept = store.read(name).join(F.broadcast(ids), "id", "left_anti")
        plan = store._laid(name, Parts(kept))._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan


def test_feeds_of_a_fetch_have_one_shuffle_between_them(spark):
    pages = ingest.fetched_pages(spark, "/root/testdata/sf0.001", 1)
    assert {r.feed for r in pages.collect()} == {"github", "raindrop", "x"}
    assert pages._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 2
