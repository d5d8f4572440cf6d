from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import catalog, listing
from tests.helpers import T0, at, by, table

URL = "https://github.com/test/repo1"
TEXTS = ("title", "summary", "keywords", "notes", "raw_content")


def batch(spark, *rows, blank_is_null=True):
    frame = table(spark, *rows).withColumn("n", F.monotonically_increasing_id())
    return catalog.collapse_batch(frame, ["n"], blank_is_null)


def test_upsert_is_new_once(spark):
    empty = table(spark, {}).limit(0)
    first = catalog.upsert(empty, batch(spark, {"title": "Test"}), T0)
    assert by(first)[URL]["is_new"]
    stored = first.drop("is_new", "changed")
    second = by(catalog.upsert(stored, batch(spark, {"title": "Updated", "source": "x"}), T0))[URL]
    assert not second["is_new"] and second["title"] == "Updated" and second["source"] == "github"


def test_mark_for_reprocess_blanks_and_queues(spark):
    done = {"scrape_status": "success", "raw_content": "raw", "summary": "s", "keywords": "k", "scraped_at": at("2024-02-01")}
    stored = table(spark, done, {"url": "u2", **done})
    ids = stored.filter(F.col("url") == URL).select("id")
    marked = catalog.mark_for_reprocess(stored, ids)
    row = by(marked)[URL]
    assert (row["scrape_status"], row["raw_content"], row["summary"], row["keywords"]) == ("pending", "", "", "")
    assert row["scraped_at"] == at("2024-02-01") and row["updated_at"] == at("2024-01-01")
    assert [r.url for r in listing.pending_queue(marked).collect()] == [URL]
    reset = by(catalog.reset_for_reprocess(stored, ids, T0))[URL]
    assert reset["scraped_at"] is None and reset["updated_at"] == at(T0)
    assert by(catalog.mark_for_reprocess(stored, ids.limit(0))) == by(stored)


def test_blank_text_keeps_or_overwrites(spark):
    stored = table(spark, {"summary": "kept", "notes": "mine", "scrape_status": "success", "raw_content": "raw"})
    incoming = {"title": "new", "summary": "", "notes": ""}
    kept = by(catalog.upsert(stored, batch(spark, incoming), T0))[URL]
    assert (kept["title"], kept["summary"], kept["notes"], kept["scrape_status"]) == ("new", "kept", "mine", "success")
    over = by(catalog.upsert(stored, batch(spark, incoming, blank_is_null=False), T0, blank_is_null=False))[URL]
    assert (over["summary"], over["notes"], over["raw_content"], over["scrape_status"]) == ("", "", "", "pending")


def sequential(stored, rows, blank_is_null):
    """Row-by-row upsert on dictionaries."""
    state = {r["url"]: dict(r) for r in stored}
    new = []
    for row in rows:
        old = state.get(row["url"])
        new.append(old is None)
        if old is None:
            state[row["url"]] = {**row, "updated_at": at(T0)}
            continue
        for c in (*TEXTS, "scraped_at", "scrape_status"):
            value = row[c]
            if blank_is_null and c in TEXTS and value == "":
                value = None
            if blank_is_null and c == "scrape_status" and old["_finished"]:
                value = None
            if value is not None:
                old[c] = value
        old["updated_at"] = at(T0)
    return state, new


@pytest.mark.parametrize("blank_is_null", [True, False])
def test_upsert_equals_row_by_row(spark, blank_is_null):
    rng = random.Random(3)

    def rows(n, urls):
        return [
            {
                "url": f"u{rng.randint(0, urls)}",
                "source": rng.choice(["github", "x", "raindrop"]),
                **{c: rng.choice(["", f"{c}{i}"]) for c in TEXTS},
                "created_at": at(f"2024-03-01 00:00:{i % 60:02d}"),
                "scraped_at": rng.choice([None, at("2024-04-01")]),
                "scrape_status": rng.choice(["pending", "success", "failed"]),
                "hidden": rng.random() < 0.2,
            }
            for i in range(n)
        ]

    unique = {r["url"]: r for r in rows(20, 25)}
    stored = table(spark, *unique.values())
    incoming = rows(60, 40)
    frame = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(table(spark, *incoming).collect())], "n int, " + _ddl(stored)
    )
    got = by(catalog.upsert(stored, catalog.collapse_batch(frame, ["n"], blank_is_null), T0, blank_is_null))
    seed = [{**r, "_finished": r["scrape_status"] == "success"} for r in by(stored).values()]
    plain = [{**r, "_finished": False} for r in _dicts(table(spark, *incoming))]
    expected, new = sequential(seed, plain, blank_is_null)
    for url, row in expected.items():
        for c in ("source", *TEXTS, "created_at", "updated_at", "scraped_at", "scrape_status", "hidden"):
            assert got[url][c] == row[c], (url, c)
    assert set(got) == set(expected)
    stats = {r.source: (r.new_items, r.skipped_items) for r in catalog.upsert_stats(stored, frame, ["n"]).collect()}
    for source in stats:
        mine = [n for n, r in zip(new, incoming) if r["source"] == source]
        assert stats[source] == (sum(mine), len(mine) - sum(mine))


def _ddl(df):
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _dicts(df):
    return [r.asDict() for r in df.collect()]


def test_orphans_and_delete(spark):
    stored = table(spark, {"url": "a"}, {"url": "b", "hidden": True}, {"url": "c", "source": "x"})
    current = spark.createDataFrame([("a",), ("a",)], "url string")
    gone = catalog.orphans(stored, current, "github")
    assert [r.url for r in gone.collect()] == ["b"]
    assert sorted(r.url for r in catalog.delete_ids(stored, gone).collect()) == ["a", "c"]
    assert sorted(r.url for r in catalog.orphans(stored, current.limit(0), "github").collect()) == ["a", "b"]


def test_edits_change_named_columns_only(spark):
    stored = table(spark, {"url": "a", "raw_content": "raw", "scraped_at": at("2024-02-01")}, {"url": "b"})
    edits = stored.filter("url = 'a'").select("id", F.lit("t" * 300).alias("title"), F.lit("n").alias("notes"))
    got = by(catalog.apply_edits(stored, edits, T0, catalog.EDIT_LIMITS))
    assert got["a"]["title"] == "t" * 256 and got["a"]["notes"] == "n" and got["a"]["raw_content"] == "raw"
    assert got["a"]["scraped_at"] == at("2024-02-01") and got["b"]["updated_at"] == at("2024-01-01")
    unknown = edits.withColumn("id", F.lit("nobody"))
    assert by(catalog.apply_edits(stored, unknown, T0)) == by(stored)


def test_manual_rows(spark):
    stored = table(spark, {"url": "a"})
    urls = spark.createDataFrame([("a",), ("b",), ("b",)], "url string")
    added = by(catalog.manual_rows(stored, urls, T0))
    assert list(added) == ["b"] and added["b"]["title"] == "b" and added["b"]["source"] == "manual"
    assert [r.url for r in catalog.already_stored(stored, urls).collect()] == ["a"]


def test_lookup_prefers_ids(spark):
    stored = table(spark, {"url": "u1", "id": "u2"}, {"url": "u2", "id": "i2"})
    keys = spark.createDataFrame([("u1",), ("u2",), ("i2",), ("none",)], "key string")
    got = {r.key: r.id for r in listing.lookup(stored, keys).collect()}
    assert got == {"u1": "u2", "u2": "u2", "i2": "i2", "none": None}


def test_listing_order_and_filters(spark):
    stored = table(
        spark,
        {"url": "a", "source": "manual", "updated_at": at("2024-05-01"), "created_at": at("2020-01-01")},
        {"url": "b", "created_at": at("2024-04-01")},
        {"url": "c", "source": "x", "created_at": at("2024-03-01")},
        {"url": "d", "created_at": at("2024-06-01"), "hidden": True},
    )
    assert [r.url for r in listing.list_recent(stored, 10).collect()] == ["a", "b", "c"]
    assert [r.url for r in listing.list_recent(stored, 10, ["X", "github "]).collect()] == ["b", "c"]
    top = listing.list_recent(stored, 2)
    assert [r.url for r in listing.post_filter(top, {"x": True, "manual": True}).collect()] == ["a"]
    assert listing.count_visible(stored).first().n == 3


def test_stale_gate(spark):
    def stale(value, now):
        rows = [("last_refresh_at", value)] if value is not None else [("other", "x")]
        return listing.is_stale(spark.createDataFrame(rows, "key string, value string"), now).first().stale

    assert stale(None, T0) and stale("soon", T0)
    assert stale("2024-05-31T12:00:00Z", T0)
    assert not stale("2024-05-31T12:00:01Z", T0)


def test_state_and_vectors_are_replaced_by_key(spark):
    state = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    put = catalog.put_state(state, spark.createDataFrame([("b", "3"), ("c", "4")], "key string, value string"))
    assert {r.key: r.value for r in put.collect()} == {"a": "1", "b": "3", "c": "4"}
    assert listing.read_state(put, "b").first().value == "3"
    assert listing.read_state(put, "zzz").first().value == ""
    assert catalog.id_collisions(table(spark, {"url": "a", "id": "1"}, {"url": "b", "id": "1"})).first().urls == 2


def test_a_merge_tells_which_urls_it_met_again(spark):
    """What ``repeated_urls`` finds by joins of its own: stored urls, and those a batch holds twice."""
    stored = table(spark, {"url": "known"}, {"url": "left alone"})
    incoming = batch(spark, {"url": "known"}, {"url": "new"}, {"url": "twice"}, {"url": "twice", "title": "later"})
    merged = catalog.upsert_met(stored, incoming, T0)
    met = {r.url for r in merged.filter("met_again").collect()}
    assert met == {r.url for r in catalog.repeated_urls(stored, incoming).collect()} == {"known", "twice"}
    assert {r.url for r in merged.filter("changed").collect()} == {"known", "new", "twice"}
