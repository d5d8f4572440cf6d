"""Jobs over a table store: sync, enrichment, index, streams."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkloom.functions import models
from linkloom.operators import fulltext, listing
from linkloom.operators.listing import hidden_ids
from linkloom.plans import enrich, index
from linkloom.plans import sync as jobs
from linkloom.session import scratch_path, shared_dir
from linkloom.sources import landing
from linkloom.sources.tables import TableStore, default_tables
from linkloom.streaming import sync as stream
from tests.helpers import T0, at, by, table
from tests.test_feeds import PAGES, drop, post, star

T1 = "2024-06-02 12:00:00"


@pytest.fixture
def store(spark):
    return TableStore(spark, scratch_path(spark, "test-store"), default_tables(3))


def pages(spark, **bodies):
    rows = [(feed, i, b if isinstance(b, str) else json.dumps(b)) for feed, many in bodies.items() for i, b in enumerate(many)]
    return spark.createDataFrame(rows, PAGES)


def urls(store):
    return sorted(r.url for r in store.read("bookmarks").collect())


def state(store):
    return {r.key: r.value for r in store.read("sync_state").collect()}


def test_store_versions_and_buckets(spark, store):
    assert store.read("bookmarks").count() == 0 and store.snapshot().version == 0
    store.commit("a", {"bookmarks": table(spark, {"url": "u1"}, {"url": "u2"}, {"url": "u3"})})
    old = store.snapshot()
    changed = table(spark, {"url": "u1", "title": "new"})
    buckets = store.touched("bookmarks", changed)
    keep = store.read("bookmarks", buckets).filter("url <> 'u1'")
    store.commit("b", {"bookmarks": keep.unionByName(changed)}, {"bookmarks": buckets})
    assert {u: r["title"] for u, r in by(store.read("bookmarks")).items()} == {"u1": "new", "u2": "t", "u3": "t"}
    assert {r.title for r in store.read("bookmarks", at=old).collect()} == {"t"}
    assert store.has_batch("a") and not store.has_batch("c")
    store.commit("c", {"bookmarks": store.read("bookmarks").limit(0)})
    assert store.read("bookmarks").count() == 0


def test_an_uncommitted_version_is_invisible_and_replaced(spark, store):
    store.commit("a", {"bookmarks": table(spark, {"url": "u1"})})
    store._write("bookmarks", table(spark, {"url": "lost"}), 2)
    assert urls(store) == ["u1"]
    store.commit("b", {"bookmarks": table(spark, {"url": "u2"})})
    assert urls(store) == ["u2"]


def test_point_reads_skip_row_groups(spark, store):
    rows = [{"url": f"u{i}"} for i in range(300)]
    store.commit("a", {"bookmarks": table(spark, *rows)})
    wanted = by(table(spark, *rows))["u7"]["id"]
    read = listing.get_by_id(store.read("bookmarks"), wanted)
    assert [r.url for r in read.collect()] == ["u7"]
    scanned = scan_rows(read)
    assert 0 < scanned < 300


def scan_rows(df):
    """Rows the file scans of an executed plan put out."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        total += metric.get().value() if metric.isDefined() else 0
    return total


def test_sync_is_incremental_and_idempotent(spark, store):
    first = pages(spark, github=[[star(2, "2024-01-02T00:00:00Z"), star(1)]], raindrop=[[drop(1)]], x=[{"tweets": [post(1)], "nextCursor": ""}])
    got = jobs.sync(store, first, T0, "b1")
    assert {r.source: (r.new_items, r.skipped_items) for r in got.stats.collect()} == {"github": (2, 0), "raindrop": (1, 0), "x": (1, 0)}
    assert got.new_items == 4 and jobs.sync(store, first, T1, "b1").skipped
    assert state(store) == {
        "github_last_sync_ts": "2024-01-02T00:00:00Z",
        "raindrop_last_sync_ts": "2024-01-01T00:00:00Z",
        "x_last_sync_ts": "2018-10-10T20:19:24Z",
        "last_refresh_at": "2024-06-01T12:00:00Z",
    }
    assert not jobs.refresh_due(store, T0) and jobs.refresh_due(store, T1)
    second = pages(spark, github=[[star(3, "2024-01-03T00:00:00Z"), star(2, "2024-01-02T00:00:00Z"), star(4, "2024-02-01T00:00:00Z")]])
    got = jobs.sync(store, second, T1, "b2", requested=["github"])
    assert got.new_items == 1 and "https://g/3" in urls(store) and "https://g/4" not in urls(store)
    assert by(store.read("bookmarks"))["https://g/1"]["updated_at"] == at(T0)
    assert state(store)["github_last_sync_ts"] == "2024-01-03T00:00:00Z"


def test_force_removes_what_the_feed_lost(spark, store):
    jobs.sync(store, pages(spark, github=[[star(1), star(2)]], raindrop=[[drop(1), drop(2)]]), T0, "b1")
    lost = store.read("bookmarks").filter("url = 'https://g/2'")
    store.commit("v", {"vectors": lost.select("id", F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit("h").alias("embedded_text_hash"))})
    got = jobs.sync(store, pages(spark, github=[[star(1)]], raindrop=[[drop(1), drop(2)]]), T1, "b2", force=True)
    assert urls(store) == ["https://g/1", "https://l/1", "https://l/2"] and got.kept_orphans == []
    assert store.read("vectors").count() == 0


def test_force_lets_a_later_feed_take_over_a_lost_url(spark, store):
    jobs.sync(store, pages(spark, github=[[star(1, html_url="https://both")]]), T0, "b1")
    jobs.sync(store, pages(spark, github=[[star(2)]], raindrop=[[drop(1, link="https://both")]]), T1, "b2", force=True)
    assert {u: r["source"] for u, r in by(store.read("bookmarks")).items()} == {"https://both": "raindrop", "https://g/2": "github"}


def test_unreadable_pages_protect_stored_rows(spark, store):
    jobs.sync(store, pages(spark, github=[[star(i) for i in range(100)], [star(200)]], x=[{"tweets": [post(1)], "nextCursor": ""}]), T0, "b1")
    damaged = pages(spark, github=[[star(i) for i in range(100)], "oops"], x=["oops"])
    got = jobs.sync(store, damaged, T1, "b2", force=True)
    assert got.failed_feeds == ["x"] and got.kept_orphans == ["github"]
    assert sorted((r.feed, r.page_no) for r in got.quarantine.collect()) == [("github", 1), ("x", 0)]
    assert "https://g/200" in urls(store) and "https://x.com/me/status/1" in urls(store)
    assert state(store)["last_refresh_at"] == "2024-06-02T12:00:00Z"


def test_an_old_page_ends_the_x_feed_before_a_bad_one(spark, store):
    page = {"tweets": [post(1)], "nextCursor": "c"}
    jobs.sync(store, pages(spark, x=[{**page, "nextCursor": ""}]), T0, "b1")
    assert jobs.sync(store, pages(spark, x=[page, "oops"]), T1, "b2").failed_feeds == []
    assert jobs.sync(store, pages(spark, x=[page, "oops"]), T1, "b3", force=True).failed_feeds == ["x"]


def test_reprocess_blanks_known_rows_only(spark, store):
    jobs.sync(store, pages(spark, raindrop=[[drop(1)]]), T0, "b1")
    jobs.sync(store, pages(spark, raindrop=[[drop(1), drop(2), drop(3), drop(3)]]), T1, "b2", force=True, reprocess=True)
    got = {u: r["summary"] for u, r in by(store.read("bookmarks")).items()}
    assert got == {"https://l/1": "", "https://l/2": "e", "https://l/3": ""}


# --- enrichment -------------------------------------------------------------------------------


def crawl(spark, **texts):
    rows = [(f"https://g/{k[1:]}", t, n) for k, many in texts.items() for n, t in enumerate(many)]
    return spark.createDataFrame(rows, "url string, content string, seq int")


def answer(prompts: pd.Series) -> pd.Series:
    return prompts.map(lambda p: None if "silent" in p else f"SUMMARY: about {p.split()[-1]}\nKEYWORDS: k1, k2")


def test_sync_enriches_when_something_is_new(spark, store):
    options = {"snapshot": crawl(spark, g1=["old text", "new words"]), "summary_model": answer}
    got = jobs.sync(store, pages(spark, github=[[star(1), star(2)]]), T0, "b1", enrichment=options)
    assert {r.outcome: r.n for r in got.tally.collect()} == {"success": 1, "fetch_failed": 1}
    rows = by(store.read("bookmarks"))
    one, two = rows["https://g/1"], rows["https://g/2"]
    assert (one["raw_content"], one["summary"], one["keywords"], one["scrape_status"]) == ("new words", "about words", "k1, k2", "success")
    assert one["title"] == "o/r1" and one["scraped_at"] == at(T0)
    assert (two["scrape_status"], two["raw_content"], two["scraped_at"]) == ("failed", "", None)
    assert [r.id for r in store.read("vectors").collect()] == [one["id"]]
    assert jobs.sync(store, pages(spark, github=[[star(1)]]), T1, "b2", enrichment=options).tally is None


def test_enrich_rules(spark):
    rows = table(
        spark,
        {"url": "https://g/1", "source": "manual", "title": "https://g/1"},
        {"url": "https://g/2", "source": "x", "title": "https://t.co/1", "keywords": "mine"},
        {"url": "https://g/3", "source": "github", "title": "o/r", "raw_content": "own silent text"},
        {"url": "https://g/4", "source": "x", "title": "words", "summary": "there", "raw_content": "text"},
        {"url": "https://g/5", "source": "manual", "title": ""},
    )
    done = by(enrich.enrich_rows(rows, T0, crawl(spark, g1=["Title: One\nbody"], g2=["Two\nbody"]), summary_model=answer))
    got = {u[-1]: (r["title"], r["summary"], r["keywords"], r["scrape_status"], r["outcome"]) for u, r in done.items()}
    assert got == {
        "1": ("One", "about body", "k1, k2", "success", "success"),
        "2": ("Two", "about body", "mine", "success", "success"),
        "3": ("o/r", "", "", "success", "success"),
        "4": ("words", "there", "", "success", "success"),
        "5": ("", "", "", "failed", "fetch_failed"),
    }
    assert all((r["embedding"] is not None) == (r["outcome"] == "success") for r in done.values())


def broken_on_long_batches(texts: pd.Series) -> pd.Series:
    if len(texts) > 1:
        raise RuntimeError("too many")
    if "three" in texts.iloc[0]:
        raise RuntimeError("no")
    return texts.map(lambda t: [float(len(t))])


def test_a_failing_batch_is_tried_row_by_row(spark):
    rows = table(spark, *[{"url": u, "raw_content": "x", "title": u} for u in ("one", "two", "three")]).coalesce(1)
    done = by(enrich.enrich_rows(rows, T0, crawl(spark), embedder=broken_on_long_batches))
    assert {u: r["embedding"] is not None for u, r in done.items()} == {"one": True, "two": True, "three": False}
    assert all(r["scrape_status"] == "success" for r in done.values())
    none = by(enrich.enrich_rows(rows, T0, crawl(spark), embedder=None))
    assert all(r["embedding"] is None and r["scrape_status"] == "success" for r in none.values())


def test_answers_are_aligned_by_number(spark):
    def shuffled(texts: pd.Series) -> pd.Series:
        answers = texts.map(lambda t: [float(len(t))]).iloc[::-1]
        return answers.drop(index=1)

    rows = table(spark, *[{"url": u, "raw_content": "x", "title": u, "summary": "s", "keywords": "k"} for u in ("a", "bb", "ccc")])
    done = by(enrich.enrich_rows(rows.coalesce(1), T0, crawl(spark), embedder=shuffled))
    found = {u: r["embedding"] for u, r in done.items()}
    assert sum(v is None for v in found.values()) == 1
    assert all(v == [len(u) + 4.0] for u, v in found.items() if v)


def test_models_see_each_wanted_row_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counting(prompts: pd.Series) -> pd.Series:
        calls.add(len(prompts))
        return prompts.map(lambda _: "SUMMARY: s\nKEYWORDS: k")

    rows = table(spark, *[{"url": f"u{i}", "raw_content": "x", "summary": "have" if i % 2 else ""} for i in range(20)])
    enrich.enrich_rows(rows, T0, crawl(spark), summary_model=counting).collect()
    assert calls.value == 10


def test_fetcher_instead_of_a_snapshot(spark):
    def fetch(wanted: pd.Series) -> pd.Series:
        return wanted.map(lambda u: None if u.endswith("2") else "é" * 30_000)

    rows = table(spark, {"url": "u1"}, {"url": "u2"}, {"url": "u3", "raw_content": "own"})
    assert len(by(enrich.acquire(rows, fetcher=fetch))["u1"]["raw_content"].encode()) == 60_000
    got = by(enrich.acquire(rows, fetcher=fetch, scrape_bytes=enrich.SHORT.scrape_bytes))
    assert len(got["u1"]["raw_content"].encode()) == 50_000 and not got["u2"]["fetched"] and got["u3"]["raw_content"] == "own"
    with pytest.raises(ValueError):
        enrich.acquire(rows)


def test_backfill_leaves_rows_without_answer_alone(spark, store):
    done = {"scrape_status": "success", "scraped_at": at("2024-02-01")}
    store.commit("a", {"bookmarks": table(
        spark,
        {"url": "u1", "raw_content": "some words", "keywords": "old", **done},
        {"url": "u2", "raw_content": "silent", "keywords": "old", **done},
        {"url": "u3", "raw_content": "", **done},
    )})
    tally = enrich.backfill(store, T1, "b", limit=None, summary_model=answer)
    assert {r.outcome: r.n for r in tally.collect()} == {"success": 1, "model_failed": 1}
    rows = by(store.read("bookmarks"))
    assert (rows["u1"]["summary"], rows["u1"]["keywords"], rows["u1"]["scraped_at"]) == ("about words", "k1, k2", at("2024-02-01"))
    assert (rows["u2"]["keywords"], rows["u2"]["updated_at"]) == ("old", at("2024-01-01"))


def test_reprocess(spark, store):
    full = {"summary": "s", "keywords": "k", "raw_content": "r", "scrape_status": "success", "scraped_at": at("2024-02-01")}
    store.commit("a", {"bookmarks": table(spark, *[{"url": f"https://g/{i}", "title": f"t{i}", **full} for i in range(1, 5)])})
    one = by(store.read("bookmarks"))["https://g/1"]["id"]
    snapshot = crawl(spark, g1=["fresh title\nwords"], g2=["silent page"])
    tally = enrich.reprocess(store, [one, "https://g/1", "https://g/2", "https://g/3", "nobody"], T1, "b", snapshot=snapshot, summary_model=answer)
    assert {r.outcome: r.n for r in tally.collect()} == {"success": 1, "model_failed": 1, "fetch_failed": 1, "not_found": 1}
    rows = by(store.read("bookmarks"))
    view = {u[-1]: (r["title"], r["summary"], r["raw_content"], r["scrape_status"], r["scraped_at"]) for u, r in rows.items()}
    assert view == {
        "1": ("fresh title", "about words", "fresh title\nwords", "success", at(T1)),
        "2": ("t2", "", "", "pending", None),
        "3": ("t3", "", "", "failed", None),
        "4": ("t4", "s", "r", "success", at("2024-02-01")),
    }


def test_add_manual(spark, store):
    store.commit("a", {"bookmarks": table(spark, {"url": "https://g/1"})})
    rejected = enrich.add_manual(store, ["https://g/1", "https://g/2", "https://g/3"], T1, "b", snapshot=crawl(spark, g2=["Page two\nwords"]), summary_model=answer)
    assert [r.url for r in rejected.collect()] == ["https://g/1"]
    rows = by(store.read("bookmarks"))
    two, three = rows["https://g/2"], rows["https://g/3"]
    assert (two["title"], two["source"], two["scrape_status"], two["summary"]) == ("Page two", "manual", "success", "about words")
    assert (three["title"], three["scrape_status"]) == ("https://g/3", "pending")
    assert [r.id for r in store.read("vectors").collect()] == [two["id"]]


def test_unknown_models_are_errors(spark):
    rows = table(spark, {"raw_content": "x"})
    with pytest.raises(ValueError):
        enrich.enrich_rows(rows, T0, crawl(spark), summary_model="nobody")
    with pytest.raises(ValueError):
        enrich.enrich_rows(rows, T0, crawl(spark), embedder="nobody")


# --- index ------------------------------------------------------------------------------------


def find(store, query):
    postings, stats = index.open_index(store)
    found = fulltext.search_index(postings, stats, hidden_ids(store.read("bookmarks")), query)
    scanned = fulltext.search_scan(store.read("bookmarks"), query)
    hits = [(r.id, round(r.score, 9), r.rank) for r in found.orderBy("rank").collect()]
    assert hits == [(r.id, round(r.score, 9), r.rank) for r in scanned.orderBy("rank").collect()]
    ids = {i: r["url"] for i, r in by(store.read("bookmarks"), "id").items()}
    return [ids[i] for i, *_ in hits]


def test_index_follows_the_catalog(spark, store):
    index.ensure_index(store, "i0")
    jobs.sync(store, pages(spark, raindrop=[[drop(i, title=f"alpha w{i}") for i in range(1, 9)]]), T0, "b1")
    assert len(find(store, "alpha")) == 8 and find(store, "w3") == ["https://l/3"]
    version = store.snapshot().version
    index.ensure_index(store, "i1")
    assert store.snapshot().version == version
    jobs.sync(store, pages(spark, raindrop=[[drop(9, created="2024-03-01T00:00:00Z", title="omega"), drop(3, created="2024-02-01T00:00:00Z", title="beta")]]), T1, "b2")
    assert find(store, "w3") == [] and find(store, "beta") == ["https://l/3"] and find(store, "ome") == ["https://l/9"]
    ids = store.read("bookmarks").filter("url = 'https://l/9'").select("id")
    jobs.remove(store, ids, "b3")
    assert find(store, "omega") == [] and "https://l/9" not in urls(store)
    jobs.edit(store, store.read("bookmarks").filter("url = 'https://l/1'").select("id", F.lit("gamma").alias("notes")), T1, "b4")
    assert find(store, "gamma alpha") == ["https://l/1"]
    index.build_index(store, "i2")
    assert store.read("postings_recent").count() == 0 and store.read("stale_ids").count() == 0
    assert find(store, "gamma alpha") == ["https://l/1"] and len(find(store, "alpha")) == 7


# --- streams ----------------------------------------------------------------------------------


def test_stream_equals_batch(spark, store):
    batch_store = TableStore(spark, scratch_path(spark, "test-store"), default_tables(3))
    landed = scratch_path(spark, "landing")
    rounds = [
        pages(spark, github=[[star(1), star(2)]], raindrop=[[drop(1)]]),
        pages(spark, github=[[star(3, "2024-02-01T00:00:00Z"), star(2)]], x=[{"tweets": [post(1)], "nextCursor": ""}]),
    ]
    checkpoint = scratch_path(spark, "stream")
    for i, batch in enumerate(rounds):
        batch.coalesce(1).write.mode("append").json(landed)
        source = landing.stream_page_rows(spark, landed)
        stream.stream_sync(source, store, "s", checkpoint, clock=lambda: T0).awaitTermination()
        jobs.sync(batch_store, batch, T0, f"b{i}")
    assert by(store.read("bookmarks")) == by(batch_store.read("bookmarks"))
    assert state(store) == state(batch_store)
    before = store.snapshot().version
    replay = landing.stream_page_rows(spark, landed, files_per_batch=1)
    stream.stream_sync(replay, store, "s", scratch_path(spark, "stream"), clock=lambda: T1).awaitTermination()
    assert store.snapshot().version == before


def test_shared_dir_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "a").startswith(shared_dir(spark))


def test_stored_bucket_count_outranks_the_spec(spark, tmp_path):
    rows = table(spark, *[{"url": f"https://e.org/{i}"} for i in range(20)])
    TableStore(spark, str(tmp_path / "s"), default_tables(4)).commit("a", {"bookmarks": rows})
    wider = TableStore(spark, str(tmp_path / "s"), default_tables(8))
    known = rows.limit(6)
    buckets = wider.touched("bookmarks", known)
    wider.commit("b", {"bookmarks": wider.read("bookmarks", buckets)}, {"bookmarks": buckets})
    assert wider.read("bookmarks").count() == wider.read("bookmarks").select("url").distinct().count() == 20


def test_commit_runs_a_batch_id_once(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"), default_tables(2))
    first = store.commit("a", {"bookmarks": table(spark, {"url": "https://e.org/1"})})
    assert store.commit("a", {"bookmarks": table(spark, {"url": "https://e.org/2"})}) == first
    assert [r.url for r in store.read("bookmarks").collect()] == ["https://e.org/1"]


def test_stream_stores_the_same_rows_for_any_batch_size(spark, tmp_path):
    root = tmp_path / "landing"
    for page_no in range(3):
        folder = root / "feed=github" / f"page_no={page_no}"
        folder.mkdir(parents=True)
        body = [star(f"a/{page_no}-{i}", f"2024-03-{20 - 5 * page_no - i:02d}T00:00:00Z") for i in range(4)]
        (folder / "page.json").write_text(json.dumps(body))
    for size in (1, 1000):
        store = TableStore(spark, scratch_path(spark, "test-store"), default_tables(3))
        landed = landing.stream_page_files(spark, str(root), size)
        stream.stream_sync(landed, store, "s", clock=lambda: T0).awaitTermination()
        assert len(urls(store)) == 12


def test_force_leaves_feeds_alone_that_did_not_land(spark, store):
    stored = table(spark, {"url": "https://github.com/old/one", "source": "github"}, {"url": "https://r.org", "source": "raindrop"})
    store.commit("seed", {"bookmarks": stored})
    jobs.sync(store, pages(spark, github=[[star("new/one", "2024-03-01T00:00:00Z")]]), T0, "b", force=True)
    assert urls(store) == ["https://g/new/one", "https://r.org"]


def test_stream_upsert_keeps_the_index_current(spark, store, tmp_path):
    store.commit("seed", {"bookmarks": table(spark, {"url": "u1", "title": "spark one"})})
    index.build_index(store, "i")
    table(spark, {"url": "u2", "title": "spark two"}).write.parquet(str(tmp_path / "rows"))
    rows = spark.readStream.schema(store.read("bookmarks").schema).parquet(str(tmp_path / "rows"))
    stream.stream_upsert(rows, store, "s", ["updated_at"], clock=lambda: T0).awaitTermination()
    assert index.open_index(store)[0].where("term = 'spark'").count() == 2


def test_a_sync_that_broke_before_its_enrichment_makes_up_for_it(spark, store, monkeypatch):
    snapshot = spark.createDataFrame([("https://g/a/one", "Title: One\nText.", 1)], "url string, content string, seq int")
    given = {"snapshot": snapshot}
    landed = pages(spark, github=[[star("a/one", "2024-05-01T00:00:00Z")]])

    def broken(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as broke:
        broke.setattr(jobs.enrich_plan, "enrich", broken)
        with pytest.raises(RuntimeError):
            jobs.sync(store, landed, T1, "b1", enrichment=given)
    assert by(store.read("bookmarks"))["https://g/a/one"]["scrape_status"] == "pending"
    again = jobs.sync(store, landed, T1, "b1", enrichment=given)
    assert again.skipped and {r.outcome: r.n for r in again.tally.collect()} == {"success": 1}
    assert by(store.read("bookmarks"))["https://g/a/one"]["scrape_status"] == "success"
    assert jobs.sync(store, landed, T1, "b1", enrichment=given).tally is None
    assert [(r.attempt, r.outcome) for r in store.read("enrich_log").collect()] == [(1, "success")]


def test_answers_are_kept_by_text(spark, store):
    calls = spark.sparkContext.accumulator(0)

    def model(prompts):
        calls.add(len(prompts))
        return prompts.map(lambda p: None if "bad" in p else f"SUMMARY: {len(p)}\nKEYWORDS: k")

    rows = table(spark, *[{"url": f"https://e.org/{i}", "raw_content": text} for i, text in enumerate(["same", "same", "other", "bad", ""])])
    store.commit("rows", {"bookmarks": rows})
    snapshot = spark.createDataFrame([("https://e.org/4", "same", 1)], "url string, content string, seq int")
    enrich.enrich(store, T0, "e1", keep_answers=True, snapshot=snapshot, summary_model=model)
    assert calls.value == 3 and store.read("answers").filter("response IS NOT NULL").count() == 2
    store.commit("more", {"bookmarks": store.read("bookmarks").unionByName(table(spark, {"url": "https://e.org/9", "raw_content": "other"}, {"url": "https://e.org/8", "raw_content": "bad"}))})
    enrich.enrich(store, T0, "e2", keep_answers=True, snapshot=snapshot, summary_model=model)
    assert calls.value == 4  # the text that failed is asked again, the known one is not
    found = by(store.read("bookmarks"))
    assert found["https://e.org/9"]["summary"] == found["https://e.org/2"]["summary"] != ""
    assert found["https://e.org/4"]["summary"] == found["https://e.org/0"]["summary"]


def test_model_batches_are_limited_in_bytes(spark):
    """A worker holds some MB of whole texts at once, not thousands of them."""
    rows = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("t"))
    held = rows.select(models.apply_model(lambda t: t.map(lambda _: str(t.str.len().sum())), F.col("t"), "string").alias("n"))
    assert held.agg(F.max(F.col("n").cast("long"))).first()[0] < 8_000_000
