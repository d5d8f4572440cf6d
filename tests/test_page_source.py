"""The feed data source: what is asked of a client, and that scans and streams see the same pages."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

import pytest

from linkloom.checks import ingest
from linkloom.sources import page_source
from linkloom.sources.page_source import FolderClient, PageRun


@dataclass
class NotingClient:
    """Pages that say their own name; every page asked for leaves a file."""

    folder: str
    counts: str  # a file with the pages of each feed

    def pages(self):
        return json.loads(Path(self.counts).read_text())

    def page(self, feed, page_no):
        (Path(self.folder) / f"{feed}-{page_no}").touch()
        return None if page_no == 3 else f"{feed} {page_no}"


@pytest.fixture()
def client(tmp_path):
    (tmp_path / "asked").mkdir()
    (tmp_path / "counts").write_text(json.dumps({"a": 20, "b": 5, "c": 0}))
    return NotingClient(str(tmp_path / "asked"), str(tmp_path / "counts"))


def asked(client):
    return {p.name for p in Path(client.folder).iterdir()}


def test_options_reach_the_client(spark, client):
    name = page_source.register(spark, client)
    found = spark.read.format(name).option("feeds", "b").option("first_page", 2).load().collect()
    assert sorted(map(tuple, found)) == [("b", 2, "b 2"), ("b", 4, "b 4")]
    assert asked(client) == {"b-2", "b-3", "b-4"}
    assert spark.read.format(name).option("feeds", "c, d").load().isEmpty()
    assert spark.read.format(name).option("end_page", 1).load().count() == 2


def test_scans_of_one_plan_keep_their_own_filters(spark, client):
    pages = spark.read.format(page_source.register(spark, client)).load()
    both = pages.filter("feed = 'a'").groupBy("feed").count().union(pages.filter("feed = 'b'").groupBy("feed").count())
    assert {r["feed"]: r["count"] for r in both.collect()} == {"a": 19, "b": 4}


def test_partitions_are_runs_of_pages():
    runs = page_source._runs({"b": (2, 5), "a": (0, 20)})
    assert runs == [PageRun("a", 0, 8), PageRun("a", 8, 16), PageRun("a", 16, 20), PageRun("b", 2, 5)]


def test_a_stream_takes_up_where_it_stopped(spark, client, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        pages = spark.readStream.format(page_source.register(spark, client)).load()
        writer = pages.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted((r.feed, r.page_no) for r in spark.read.schema(page_source.SCHEMA).parquet(out).collect())

    first = run()
    assert first == [(f, n) for f, count in (("a", 20), ("b", 5)) for n in range(count) if n != 3]
    Path(client.counts).write_text(json.dumps({"a": 20, "b": 7, "c": 1}))
    for p in Path(client.folder).iterdir():
        p.unlink()
    assert run() == sorted([*first, ("b", 5), ("b", 6), ("c", 0)])
    assert asked(client) == {"b-5", "b-6", "c-0"}


def test_folder_client(tmp_path):
    for feed, no in (("x", 0), ("x", 2), ("github", 0)):
        folder = tmp_path / "pages" / f"feed={feed}" / f"page_no={no}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text(f"[{no}]\n")
        (folder / "_SUCCESS").touch()
    for uri in (str(tmp_path / "pages"), f"file://{tmp_path}/pages"):
        client = FolderClient(uri)
        assert client.pages() == {"x": 3, "github": 1}
        assert client.page("x", 2) == "[2]\n" and client.page("x", 1) is None
    assert FolderClient(str(tmp_path / "nothing")).pages() == {}


def test_many_pages_make_longer_runs():
    assert [len(page_source._runs({"a": (0, n)})) for n in (2048, 256 * 20, 256 * 640)] == [256, 256, 2560]


@dataclass
class CountingFolder(FolderClient):
    def page(self, feed, page_no):
        with open(f"{self.uri}-asked", "a") as out:
            out.write(f"{feed}-{page_no}\n")
        return super().page(feed, page_no)


def test_a_scan_asks_for_each_page_once(spark, monkeypatch):
    clients = []
    monkeypatch.setattr(page_source, "FolderClient", lambda uri: clients.append(CountingFolder(uri)) or clients[-1])
    ingest.feed_source_scan(spark, "/root/testdata/sf0.001").count()
    lines = Path(f"{clients[0].uri}-asked").read_text().splitlines()
    assert lines and sorted(lines) == sorted(set(lines))
