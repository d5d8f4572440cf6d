"""The set rules against page loops written from their description."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from linkloom.operators import incremental

NOW = "2024-06-01 12:00:00"
BASE = datetime(2024, 1, 1)
ITEMS = "feed string, page_no int, pos int, ts timestamp, n int"


def take_loop(pages, mark):
    taken, newest = [], None
    for page in pages:
        for n, ts in page:
            eff = (ts or datetime.fromisoformat(NOW)).replace(microsecond=0)
            newest = eff if newest is None or eff > newest else newest
            if mark is not None and eff <= mark:
                return taken, newest
            taken.append(n)
    return taken, newest


def page_loop(pages, mark):
    taken, newest = [], None
    for page in pages:
        fresh = False
        for n, ts in page:
            sec = ts and ts.replace(microsecond=0)
            if sec and (newest is None or sec > newest):
                newest = sec
            if mark is not None and sec and sec <= mark:
                continue
            fresh = True
            taken.append(n)
        if mark is not None and not fresh:
            break
    return taken, newest


def random_feeds(seed, feeds=60):
    rng = random.Random(seed)
    result = {}
    for f in range(feeds):
        n, pages = 0, []
        for _ in range(rng.randint(1, 5)):
            page = []
            for _ in range(rng.randint(1, 4)):
                undated = rng.random() < 0.2
                page.append((n, None if undated else BASE + timedelta(seconds=rng.randint(0, 40), microseconds=rng.randint(0, 9) * 100000)))
                n += 1
            pages.append(page)
        result[f"f{f}"] = (pages, None if rng.random() < 0.2 else BASE + timedelta(seconds=rng.randint(0, 40)))
    return result


def frames(spark, feeds):
    rows = [
        (name, p, i, ts, n) for name, (pages, _) in feeds.items() for p, page in enumerate(pages) for i, (n, ts) in enumerate(page)
    ]
    marks = [(name, mark) for name, (_, mark) in feeds.items()]
    return spark.createDataFrame(rows, ITEMS), spark.createDataFrame(marks, "feed string, mark timestamp")


def kept(df):
    out = {}
    for row in df.select("feed", "n").collect():
        out.setdefault(row.feed, []).append(row.n)
    return {f: sorted(v) for f, v in out.items()}


def test_rules_match_the_loops(spark):
    feeds = random_feeds(7)
    items, marks = frames(spark, feeds)
    for loop, taken, newest in (
        (take_loop, incremental.take_while_newer(items, marks, NOW), incremental.take_while_marks(items, marks, NOW)),
        (page_loop, incremental.filter_in_page(items, marks), incremental.filter_in_page_marks(items, marks)),
        (page_loop, incremental.filter_in_page(items, marks, few_feeds=True), incremental.filter_in_page_marks(items, marks, few_feeds=True)),
    ):
        expected = {f: loop(*given) for f, given in feeds.items()}
        assert kept(taken) == {f: e[0] for f, e in expected.items() if e[0]}
        assert {r.feed: r.newest for r in newest.collect()} == {f: e[1] for f, e in expected.items()}


def test_undated_row_after_the_first_old_one_is_lost(spark):
    mark = BASE + timedelta(seconds=10)
    feeds = {"f": ([[(0, BASE + timedelta(seconds=20)), (1, mark), (2, None)]], mark)}
    items, marks = frames(spark, feeds)
    assert kept(incremental.take_while_newer(items, marks, NOW)) == {"f": [0]}
    assert kept(incremental.filter_in_page(items, marks)) == {"f": [0, 2]}


def test_marks_never_move_back_unless_asked(spark):
    marks = spark.createDataFrame([("a", BASE), ("b", None), ("c", BASE)], "feed string, mark timestamp")
    newest = spark.createDataFrame([("a", BASE - timedelta(days=1)), ("b", BASE)], "feed string, newest timestamp")
    ahead = {r.feed: r.mark for r in incremental.advance_marks(marks, newest).collect()}
    assert ahead == {"a": BASE, "b": BASE, "c": BASE}
    back = {r.feed: r.mark for r in incremental.advance_marks(marks, newest, never_back=False).collect()}
    assert back["a"] == BASE - timedelta(days=1) and back["c"] == BASE


def test_marks_and_state(spark):
    state = spark.createDataFrame([("x_last_sync_ts", "2024-01-01T00:00:00Z"), ("github_last_sync_ts", "soon")], "key string, value string")
    marks = incremental.marks_from_state(state, ["x", "github", "raindrop"])
    assert {r.feed: r.mark for r in marks.collect()} == {"x": BASE, "github": None, "raindrop": None}
    assert [tuple(r) for r in incremental.marks_to_state(marks).collect()] == [("x_last_sync_ts", "2024-01-01T00:00:00Z")]
    assert all(r.mark is None for r in incremental.marks_from_state(state, ["x"], force=True).collect())
