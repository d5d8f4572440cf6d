"""Feeds as a Spark data source: ``spark.read.format("feed_pages")`` and the same as a stream.

What a feed is behind is a client: a small object that is sent to the tasks and says which feeds there are,
how many pages each has, and what a page holds. A page is a unit of work: tasks get runs of pages of one
feed, options name the feeds and pages to ask for, and a stream's offset is the number of pages taken from
each feed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "feed_pages"
SCHEMA = "feed string, page_no int, body string"
#: Pages of one feed that a task asks for one after the other: few, for many tasks, until there are ``RUNS`` runs;
#: then more, up to some tens of MB, because a task's start costs as much as several pages.
RUN, LONGEST_RUN, RUNS = 8, 64, 256


class Client(Protocol):
    def pages(self) -> dict[str, int]:
        """How many pages each feed has now; they are numbered from 0 and stay."""

    def page(self, feed: str, page_no: int) -> str | None:
        """The body of a page, None where there is none."""


@dataclass
class FolderClient:
    """Page files below ``uri/feed=<name>/page_no=<n>/`` in any file system Arrow can open."""

    uri: str

    def _root(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri if "://" in self.uri or self.uri.startswith("file:") else f"file://{self.uri}")

    def _files(self, folder: str) -> list[str]:
        from pyarrow import fs

        system, path = self._root()
        found = system.get_file_info(fs.FileSelector(f"{path}/{folder}".rstrip("/"), recursive=True, allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and not f.base_name.startswith((".", "_")))

    def pages(self) -> dict[str, int]:
        counts: dict[str, int] = {}
        for path in self._files(""):
            if m := re.search(r"/feed=([^/]+)/page_no=(\d+)/[^/]+$", path):
                counts[m[1]] = max(counts.get(m[1], 0), int(m[2]) + 1)
        return counts

    def page(self, feed: str, page_no: int) -> str | None:
        system, _ = self._root()
        parts = []
        for path in self._files(f"feed={feed}/page_no={page_no}"):
            with system.open_input_stream(path) as file:
                parts.append(file.read().decode())
        return "".join(parts) if parts else None


@dataclass
class PageRun(InputPartition):
    feed: str
    first: int
    end: int


def _runs(ranges: dict[str, tuple[int, int]]) -> list[PageRun]:
    total = sum(max(0, end - first) for first, end in ranges.values())
    run = max(RUN, min(LONGEST_RUN, total // RUNS))
    return [PageRun(feed, at, min(at + run, end)) for feed, (first, end) in sorted(ranges.items()) for at in range(first, end, run)]


def _read(client: Client, run: PageRun) -> Iterator[tuple]:
    for page_no in range(run.first, run.end):
        body = client.page(run.feed, page_no)
        if body is not None:
            yield run.feed, page_no, body


class _Batch(DataSourceReader):
    """Pages chosen by the options ``feeds`` (names between commas), ``first_page`` and ``end_page``.

    Filters are not pushed down: one loaded table has one reader in Spark, so what one scan of it is told
    would hold for every other scan of the same plan.
    """

    def __init__(self, client: Client, options: dict[str, str]):
        self.client = client
        self.feeds = {f.strip() for f in options["feeds"].split(",")} if "feeds" in options else None
        self.first = int(options.get("first_page", 0))
        self.end = int(options["end_page"]) if "end_page" in options else None

    def partitions(self) -> list[PageRun]:
        counts = self.client.pages()
        wanted = counts if self.feeds is None else {f: n for f, n in counts.items() if f in self.feeds}
        return _runs({f: (self.first, n if self.end is None else min(n, self.end)) for f, n in wanted.items()})

    def read(self, partition: PageRun | None) -> Iterator[tuple]:
        # Without any page Spark asks for one empty partition.
        return _read(self.client, partition) if partition else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, client: Client):
        self.client = client

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.client.pages()

    def partitions(self, start: dict, end: dict) -> list[PageRun]:
        return _runs({feed: (start.get(feed, 0), n) for feed, n in end.items()})

    def read(self, partition: PageRun | None) -> Iterator[tuple]:
        return _read(self.client, partition) if partition else iter(())

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession, client: Client, name: str = FORMAT) -> str:
    """Makes the pages of ``client`` readable under the format ``name``, which is returned.

    Rows are ``feed, page_no, body``, as landed pages are. Registering again under a name replaces its client.
    """

    class FeedPages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Batch(client, self.options)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return _Stream(client)

    spark.dataSource.register(FeedPages)
    return name
