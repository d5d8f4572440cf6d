"""Browsing: filters, ordered listings, queues and point reads over the bookmark table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import parse_rfc3339
from ..schema import FAILED, FEED_SOURCES, LAST_REFRESH_KEY, LISTING_COLUMNS, PENDING
from ..session import stage, timestamp
from .skew import near_keys

REFRESH_HOURS = 24


def visible(bookmarks: DataFrame) -> DataFrame:
    return bookmarks.filter(~F.col("hidden"))


def hidden_ids(bookmarks: DataFrame) -> DataFrame:
    return bookmarks.filter("hidden").select("id")


def from_sources(bookmarks: DataFrame, sources: Iterable[str] = ()) -> DataFrame:
    """Rows of the named sources; an empty list means no filter."""
    names = sorted({s.strip().lower() for s in sources})
    return bookmarks.filter(F.col("source").isin(names)) if names else bookmarks


def listing_time() -> Column:
    return F.when(F.col("source").isin(*FEED_SOURCES), F.col("created_at")).otherwise(F.col("updated_at"))


def list_recent(bookmarks: DataFrame, limit: int, sources: Iterable[str] = ()) -> DataFrame:
    """Visible rows, newest first."""
    rows = from_sources(visible(bookmarks), sources)
    return rows.orderBy(listing_time().desc(), F.col("id")).select(*LISTING_COLUMNS).limit(limit)


def post_filter(results: DataFrame, enabled: dict[str, bool]) -> DataFrame:
    """Source switches applied to rows already cut by a limit; unknown sources are dropped."""
    return results.filter(F.col("source").isin([s for s, on in enabled.items() if on]))


def count_visible(bookmarks: DataFrame) -> DataFrame:
    return visible(bookmarks).agg(F.count("*").alias("n"))


def pending_queue(bookmarks: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows waiting for enrichment, hidden ones included, oldest first when limited."""
    queue = bookmarks.filter(F.col("scrape_status").isin(PENDING, FAILED))
    return queue if limit is None else queue.orderBy("created_at", "id").limit(limit)


def needs_summary(bookmarks: DataFrame, limit: int | None = None) -> DataFrame:
    """Visible rows with page text but no summary, latest update first when limited."""
    rows = visible(bookmarks).filter(
        (F.col("raw_content") != "") & (F.coalesce(F.col("summary"), F.lit("")) == "")
    )
    if not limit or limit < 0:
        return rows
    return rows.orderBy(F.col("updated_at").desc(), F.col("id")).limit(limit)


def get_by_id(bookmarks: DataFrame, key: str) -> DataFrame:
    """Point read; stored files carry a Bloom filter on ``id`` and ``url`` that skips row groups."""
    return bookmarks.filter(F.col("id") == key)


def get_by_url(bookmarks: DataFrame, url: str) -> DataFrame:
    return bookmarks.filter(F.col("url") == url)


def lookup(bookmarks: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows for a ``key`` column holding ids or urls; an id match hides a url match.

    Keys without a match come back with a NULL ``id``.
    """
    wanted = stage(keys.select("key").distinct(), "keys")
    near, few = near_keys(wanted)
    names = bookmarks.select("id", "url")
    by_id = names.withColumn("key", F.col("id")).join(near, "key", "left_semi")
    rest = wanted.join(by_id.select("key"), "key", "left_anti")
    by_url = names.withColumn("key", F.col("url")).join(F.broadcast(rest) if few else rest, "key", "left_semi")
    # Matches are found on ids and urls alone; of whole rows only the found ones are taken, in one join.
    found = stage(by_id.unionByName(by_url).distinct(), "found")
    named = near_keys(found)[0].withColumnsRenamed({"id": "_id", "url": "_url"})
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("url").eqNullSafe(F.col("_url"))
    rows = bookmarks.join(named, same).select("key", *bookmarks.columns)
    missed = wanted.join(found.select("key"), "key", "left_anti")
    return rows.unionByName(missed.select("key", *[F.lit(None).cast(t).alias(c) for c, t in bookmarks.dtypes]))


def is_stale(sync_state: DataFrame, now: str | Column, key: str = LAST_REFRESH_KEY) -> DataFrame:
    """One row telling whether the last refresh is missing, unreadable or a day old."""
    stamp = parse_rfc3339(F.max(F.when(F.col("key") == key, F.col("value"))))
    age = F.unix_micros(timestamp(now)) - F.unix_micros(stamp)
    old = age >= F.lit(REFRESH_HOURS * 3600 * 1_000_000)
    return sync_state.agg(F.coalesce(old, F.lit(True)).alias("stale"))


def read_state(sync_state: DataFrame, key: str) -> DataFrame:
    """One row with the value saved under ``key``, blank when there is none."""
    value = F.max(F.when(F.col("key") == key, F.col("value")))
    return sync_state.agg(F.coalesce(value, F.lit("")).alias("value"))
