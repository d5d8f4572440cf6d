"""Fetches of a stream: how far each reads, what waits, and what a late page may change."""

from __future__ import annotations

import json

import pytest

from linkloom.checks.ingest import new_store
from linkloom.plans.sync import sync
from linkloom.schema import FETCHED_PAGE_SCHEMA
from linkloom.sources import feeds
from linkloom.sources.landing import FetchedPages
from linkloom.streaming.fetches import Reading, read_fetch
from linkloom.streaming.sync import stream_sync_fetches

from .helpers import at, by

END = (False, True, [])


def page(*secs, ends=False, bad=False):
    return bad, ends, list(secs)


@pytest.mark.parametrize(
    "spec, pages, mark, expected",
    [
        (feeds.GITHUB, {0: page(9, 8), 1: page(7, 6)}, None, None),
        (feeds.GITHUB, {0: page(9, 8), 2: page(5), 1: page(7, 6, ends=True)}, None, Reading([(0, 2), (1, 2)], 9)),
        (feeds.GITHUB, {0: page(9, 8), 1: page(7, 6)}, 7, Reading([(0, 2), (1, 0)], 9)),
        (feeds.GITHUB, {1: page(7, 6)}, 7, None),
        (feeds.GITHUB, {0: page(None, 8), 1: page(3)}, 7, Reading([(0, 2), (1, 0)], 50)),
        (feeds.GITHUB, {0: page(9), 1: page(bad=True)}, 7, Reading([(0, 1)], 9)),
        (feeds.GITHUB, {0: page(bad=True)}, 7, Reading([], None, True)),
        (feeds.GITHUB, {0: END}, None, Reading([(0, 0)], None)),
        (feeds.X, {0: page(9, 6, 8), 1: page(None, 5), 2: page(4, 5)}, 7, Reading([(0, 3), (1, 2), (2, 2)], 9)),
        (feeds.X, {0: page(9), 1: page(bad=True)}, 7, Reading([], None, True)),
        (feeds.X, {0: page(3), 1: page(bad=True)}, 7, Reading([(0, 1)], 3)),
    ],
)
def test_how_far_a_fetch_reads(spec, pages, mark, expected):
    assert read_fetch(spec, pages, mark, 50, 0) == expected


def test_a_fetch_that_is_given_up_reads_what_there_is():
    pages = {1: page(7, 6), 3: page(5, 2)}
    assert read_fetch(feeds.GITHUB, pages, 4, 50, 0, as_is=True) == Reading([(1, 2), (3, 1)], 7)


def starred(name, when):
    return {"starred_at": when, "repo": {"full_name": name, "html_url": f"https://github.com/{name}", "description": "d"}}


def land(spark, path, *pages):
    """Pages of ``(page_no, fetched_at, items)`` in one file."""
    rows = [("github", no, json.dumps(items) if not isinstance(items, str) else items, at(when)) for no, when, items in pages]
    spark.createDataFrame(rows, FETCHED_PAGE_SCHEMA).coalesce(1).write.mode("append").json(path)


def run(spark, store, path, checkpoint, **options):
    pages = FetchedPages(spark, path, files_per_batch=1)
    stream_sync_fetches(pages, store, "s", enabled=["github"], checkpoint=checkpoint, **options).awaitTermination()
    return {r["title"]: r for r in by(store.read("bookmarks")).values()}


def full(names, start):
    """A full page, newest first."""
    return [starred(n, f"2024-05-{start - i // 24:02d}T{23 - i % 24:02d}:00:00Z") for i, n in enumerate(names)]


def test_a_late_page_of_an_open_fetch_overwrites_nothing_newer(spark, tmp_path):
    path, checkpoint = str(tmp_path / "landed"), str(tmp_path / "checkpoint")
    store = new_store(spark)
    first, last = full([f"a/{i}" for i in range(100)], 20), [starred("a/last", "2024-05-01T00:00:00Z"), starred("a/5", "2024-05-01T00:00:00Z")]
    again = [starred("b/new", "2024-05-30T00:00:00Z"), starred("a/0", "2024-05-29T00:00:00Z"), *first]
    land(spark, path, (1, "2024-06-01", last))
    land(spark, path, (0, "2024-06-02", again[:100]))
    assert run(spark, store, path, checkpoint) == {}
    land(spark, path, (0, "2024-06-01", first))
    found = run(spark, store, path, checkpoint)
    batch = new_store(spark)
    for day, pages in (("2024-06-01", [first, last]), ("2024-06-02", [again[:100]])):
        rows = [("github", no, json.dumps(p)) for no, p in enumerate(pages)]
        sync(batch, spark.createDataFrame(rows, "feed string, page_no int, body string"), day, day, enabled=["github"])
    plain = {r["title"]: r for r in by(batch.read("bookmarks")).values()}
    assert found == plain and len(found) == 102
    assert found["a/0"]["updated_at"] == at("2024-06-02") and found["a/1"]["updated_at"] == at("2024-06-01")
    marks = {r.key: r.value for r in store.read("sync_state").collect()}
    assert marks == {r.key: r.value for r in batch.read("sync_state").collect()}
    assert store.read("fetch_log").isEmpty()


def test_a_page_after_its_fetch_was_closed_only_adds(spark, tmp_path):
    path, checkpoint = str(tmp_path / "landed"), str(tmp_path / "checkpoint")
    store = new_store(spark)
    land(spark, path, (0, "2024-06-01", [starred("a/1", "2024-05-03T00:00:00Z"), starred("a/2", "2024-05-02T00:00:00Z")]))
    assert set(run(spark, store, path, checkpoint)) == {"a/1", "a/2"}
    changed = starred("a/1", "2024-05-03T00:00:00Z")
    changed["repo"]["description"] = "older text"
    land(spark, path, (1, "2024-06-01", [starred("a/3", "2024-05-01T00:00:00Z"), changed]))
    found = run(spark, store, path, checkpoint)
    assert set(found) == {"a/1", "a/2", "a/3"} and found["a/1"]["summary"] == "d"
    assert run(spark, store, path, checkpoint) == found


def test_an_unreadable_page_ends_a_fetch(spark, tmp_path):
    path, checkpoint = str(tmp_path / "landed"), str(tmp_path / "checkpoint")
    store = new_store(spark)
    land(spark, path, (0, "2024-06-01", full([f"a/{i}" for i in range(100)], 20)), (1, "2024-06-01", "<html>"), (2, "2024-06-01", [starred("b/1", "2024-05-01T00:00:00Z")]))
    found = run(spark, store, path, checkpoint)
    assert len(found) == 100 and "b/1" not in found


def test_a_timer_gives_up_waiting(spark, tmp_path):
    path, checkpoint = str(tmp_path / "landed"), str(tmp_path / "checkpoint")
    store = new_store(spark)
    land(spark, path, (1, "2024-06-01", [starred("a/1", "2024-05-03T00:00:00Z")]))
    pages = FetchedPages(spark, path)
    query = stream_sync_fetches(pages, store, "s", enabled=["github"], checkpoint=checkpoint, patience_ms=500, once=False, every="1 second")
    try:
        for _ in range(60):
            if not query.isActive or not store.read("bookmarks").isEmpty():
                break
            query.awaitTermination(0.5)
    finally:
        query.stop()
    assert query.exception() is None and [r["title"] for r in by(store.read("bookmarks")).values()] == ["a/1"]
