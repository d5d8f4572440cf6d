from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from linkloom.sources import feeds, landing, sinks
from tests.helpers import T0, at, by, table

PAGES = "feed string, page_no int, body string"


def read(spark, spec, *bodies, first=0):
    pages = spark.createDataFrame([(spec.name, first + i, b) for i, b in enumerate(bodies)], PAGES)
    landed = feeds.landed_rows(spec, pages, T0).cache()
    return landed, sorted(feeds.reachable(landed).collect(), key=lambda r: (r.page_no, r.pos))


def star(n, when="2024-01-01T00:00:00Z", **repo):
    return {"starred_at": when, "repo": {"full_name": f"o/r{n}", "html_url": f"https://g/{n}", "description": None, **repo}}


def drop(n, **given):
    return {"_id": n, "title": f"t{n}", "link": f"https://l/{n}", "excerpt": "e", "note": "n", "created": "2024-01-01T00:00:00Z", "tags": ["a", "b"], **given}


def post(n, **given):
    author = {"username": "me", "name": "Me"}
    return {"id": str(n), "text": f"text {n}", "createdAt": "Wed Oct 10 20:19:24 +0000 2018", "author": author, **given}


def test_github_rows(spark):
    body = json.dumps([star(1), star(2, when="bad", description="d"), star(3, when="2024-01-01T02:00:00.25+02:00")])
    _, rows = read(spark, feeds.GITHUB, body)
    assert [(r.url, r.title, r.summary) for r in rows] == [("https://g/1", "o/r1", ""), ("https://g/2", "o/r2", "d"), ("https://g/3", "o/r3", "")]
    assert [r.created_at for r in rows] == [at("2024-01-01"), at(T0), at("2024-01-01 00:00:00.250")]
    assert [r.ts for r in rows][1] is None and rows[0].scrape_status == "pending" and rows[0].raw_content == ""


def test_arrays_printed_back_to_back(spark):
    tricky = star(1, description='][ "quoted" \\ ] [')
    body = json.dumps([tricky]) + " \n" + json.dumps([star(2)]) + json.dumps([]) + json.dumps([star(3)])
    _, rows = read(spark, feeds.GITHUB, body.replace("[]", "[" + json.dumps(star(9)) + "]"))
    assert [r.url for r in rows] == ["https://g/1", "https://g/2", "https://g/9", "https://g/3"]
    assert rows[0].summary == '][ "quoted" \\ ] ['
    landed, rows = read(spark, feeds.RAINDROP, json.dumps([drop(1)]) + json.dumps([drop(2)]))
    assert rows == [] and feeds.quarantine(landed).count() == 1


def test_empty_arrays_between_joined_ones(spark):
    one, two = json.dumps([star(1)]), json.dumps([star(2)])
    for body in (f"{one}[]{two}[]", f"[ ]\n[]{one}{two}", f"{one} [] [\n] {two}", f"{one}{two}[][]", f"[][]{one}[]{two}[]"):
        _, rows = read(spark, feeds.GITHUB, body)
        assert [r.url for r in rows] == ["https://g/1", "https://g/2"], body
    landed, rows = read(spark, feeds.GITHUB, "[][]")
    assert rows == [] and feeds.quarantine(landed).count() == 0


def test_a_short_page_ends_the_feed(spark):
    full, short = json.dumps([drop(i) for i in range(50)]), json.dumps([drop(i) for i in range(50, 60)])
    later = json.dumps([drop(99)])
    assert len(read(spark, feeds.RAINDROP, full, short, later)[1]) == 60
    assert len(read(spark, feeds.RAINDROP, full, "[]", later)[1]) == 50
    assert len(read(spark, feeds.RAINDROP, full, "null", later)[1]) == 50


def test_raindrop_envelopes_and_tags(spark):
    body = json.dumps({"items": [drop(1, tags=None, excerpt=None), drop(2, tags=["a", None, "c"]), drop(3, tags=[])]})
    _, rows = read(spark, feeds.RAINDROP, body)
    assert [r.keywords for r in rows] == ["", "a,,c", ""] and rows[0].summary == ""
    landed, rows = read(spark, feeds.RAINDROP, '{"other": 1}')
    assert rows == [] and feeds.quarantine(landed).count() == 0


def test_x_pages_follow_the_cursor(spark):
    one = json.dumps({"tweets": [post(1), post(2, text="é" * 60)], "nextCursor": "c"})
    two = json.dumps({"tweets": [post(3, createdAt="soon", author=None)], "nextCursor": ""})
    three = json.dumps({"tweets": [post(4)], "nextCursor": "d"})
    _, rows = read(spark, feeds.X, one, two, three)
    assert [r.url for r in rows] == ["https://x.com/me/status/1", "https://x.com/me/status/2", "https://x.com//status/3"]
    assert rows[1].title == "é" * 50 + "..." and rows[0].created_at == at("2018-10-10 20:19:24")
    assert rows[2].created_at == at(T0) and rows[2].ts is None
    assert len(read(spark, feeds.X, json.dumps([post(1)]), one)[1]) == 1


@pytest.mark.parametrize("body", ["", "garbage", '[{"a":1}', '{"tweets":[{"id":"1"}', "[1] tail", "{} tail"])
def test_unreadable_pages_are_kept_aside(spark, body):
    for spec in feeds.FEEDS.values():
        landed, rows = read(spark, spec, body)
        assert rows == [] and [r.body for r in feeds.quarantine(landed).collect()] == [body]


def test_an_unreadable_page_ends_the_feed_before_it(spark):
    full = json.dumps([star(i) for i in range(100)])
    landed, rows = read(spark, feeds.GITHUB, full, "oops", full)
    assert len(rows) == 100
    reach = feeds.page_reach(landed).first()
    assert (reach.bad_page, reach.first_page) == (1, 0)
    landed, rows = read(spark, feeds.GITHUB, json.dumps({"items": []}))
    assert feeds.quarantine(landed).count() == 1


def test_feed_selection():
    names = lambda *a: [s.name for s in feeds.select_feeds(*a)]
    assert names(["raindrop", "x", "github"]) == ["github", "x", "raindrop"]
    assert names(["github", "x"], [" X "]) == ["x"]
    with pytest.raises(ValueError):
        feeds.select_feeds(["github"], ["x"])


def test_page_files(spark, tmp_path):
    for feed, page, body in (("github", 0, "[\n]"), ("x", 12, '{"a":\n1}')):
        folder = tmp_path / f"feed={feed}" / f"page_no={page}"
        folder.mkdir(parents=True)
        (folder / "page.json").write_text(body)
    rows = landing.read_page_files(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, rows)) == [("github", 0, "[\n]"), ("x", 12, '{"a":\n1}')]


def test_sinks(spark, tmp_path):
    rows = table(spark, {"url": "u1", "title": "a\tb", "source": "x", "summary": "s" * 101}, {"url": "u2", "title": "c"})
    rows = rows.withColumn("rank", F.when(F.col("url") == "u1", 2).otherwise(1))
    sinks.write_json(rows, str(tmp_path / "json"))
    shown = {r["url"]: r for r in map(json.loads, (r.value for r in spark.read.text(str(tmp_path / "json")).collect()))}
    assert "summary" not in shown["u2"] and "scraped_at" not in shown["u2"] and shown["u2"]["hidden"] is False
    assert set(shown["u1"]) == {"id", "source", "url", "title", "summary", "created_at", "updated_at", "scrape_status", "hidden"}
    sinks.write_tsv(rows, str(tmp_path / "tsv"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "tsv")).collect()) == ["github\tc\tu2", "x\ta b\tu1"]
    sinks.write_text(rows, str(tmp_path / "text"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "text"), wholetext=True).collect())
    assert "1. [G] c\n   u2" in text and f"2. [X] a\tb\n   u1\n   {'s' * 97}..." in text
    assert by(rows)["u1"]["title"] == "a\tb"
