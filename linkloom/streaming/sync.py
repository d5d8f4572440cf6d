"""Continuous sync with Structured Streaming.

Both jobs run their batch logic in ``foreachBatch`` and name the commit after the stream and batch
id, so a batch replayed after a failure finds its own commit and changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import catalog, incremental
from ..plans import index as index_plan
from ..plans.sync import publish, sync
from ..schema import BOOKMARK_COLUMNS
from ..session import scratch_path, stage
from ..sources import feeds as feed_source
from ..sources.feeds import FeedSpec
from ..sources.landing import FetchedPages
from ..sources.tables import TableStore
from . import fetches


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


def drop_repeats(rows: DataFrame, event_time: str, delay: str, key: str = "url") -> DataFrame:
    """Drop repeats of a url that arrive within ``delay``; later rows than that are late.

    Columns without a time zone cannot carry a watermark, so the event time is cast first.
    """
    timed = rows.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return timed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def _start(rows: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str | None, once: bool, every: str):
    writer = rows.writeStream.foreachBatch(step)
    writer = writer.option("checkpointLocation", checkpoint or scratch_path(rows.sparkSession, "stream"))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def stream_sync(
    pages: DataFrame,
    store: TableStore,
    name: str,
    checkpoint: str | None = None,
    clock: Callable[[], str] = utc_now,
    once: bool = True,
    every: str = "1 minute",
    **sync_options,
) -> StreamingQuery:
    """Sync a stream of ``(feed, page_no, body)``.

    A micro-batch may hold any part of a fetch, so no landed page is cut off by the marks or by an
    earlier page: the size of a micro-batch never decides which rows are stored.
    """

    def step(batch: DataFrame, batch_no: int) -> None:
        sync(store, batch, clock(), f"{name}:{batch_no}", every_page=True, **sync_options)

    return _start(pages, step, checkpoint, once, every)


def stream_upsert(
    rows: DataFrame,
    store: TableStore,
    name: str,
    order: list[str],
    checkpoint: str | None = None,
    clock: Callable[[], str] = utc_now,
    blank_is_null: bool = True,
    once: bool = True,
    every: str = "1 minute",
) -> StreamingQuery:
    """Merge a stream of bookmark rows into the store; ``order`` is the order within a batch."""

    def step(batch: DataFrame, batch_no: int) -> None:
        batch_id = f"{name}:{batch_no}"
        if store.has_batch(batch_id):
            return
        folded = stage(catalog.collapse_batch(batch, order, blank_is_null), "batch")
        buckets = store.touched("bookmarks", folded)
        existing = store.read("bookmarks", buckets)
        merged = catalog.upsert(existing, folded, clock(), blank_is_null).select(*BOOKMARK_COLUMNS)
        changes, touched = {"bookmarks": merged}, {"bookmarks": buckets}
        if index_plan.is_current(store):
            changed = stage(catalog.batch_ids(existing, folded), "changed")
            index_changes, index_touched = index_plan.changes_for(store, changed, merged)
            changes |= index_changes
            touched |= index_touched
        store.commit(batch_id, changes, touched)

    return _start(rows, step, checkpoint, once, every)


_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _settings(spark: SparkSession, **conf: str):
    """Session settings while a query is started; the query takes them along."""
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stream_sync_fetches(
    landed: FetchedPages,
    store: TableStore,
    name: str,
    enabled: Iterable[str] = ("github", "x", "raindrop"),
    requested: Iterable[str] = (),
    first_page: int = 0,
    patience_ms: int = 3_600_000,
    checkpoint: str | None = None,
    once: bool = True,
    every: str = "1 minute",
    blank_is_null: bool = True,
) -> StreamingQuery:
    """Sync a stream of landed pages fetch by fetch, whatever order they come in.

    Each fetch reads as far as the mark its predecessor left allows, as batch syncs of the fetches
    one after the other would: pages wait for missing ones before them (``patience_ms`` at most), and a
    fetch is merged once no earlier one is open, so an old page that lands late overwrites nothing newer.
    A page that comes after its fetch was given up adds the urls that are not stored yet and changes
    none. Texts stay in the landing folder until their page is decided; the stream's state holds times.
    """
    spark = store.spark
    specs = feed_source.select_feeds(enabled, requested)
    marks = incremental.marks_from_state(store.read("sync_state"), [s.name for s in specs])
    saved = marks.select("feed", F.unix_seconds("mark").alias("mark"))
    decided = fetches.decisions(specs, landed.stream(), saved, first_page, patience_ms)

    def step(batch: DataFrame, batch_no: int) -> None:
        log_id = f"{name}:{batch_no}:decisions"
        if not store.has_batch(log_id):
            log = store.read("fetch_log").unionByName(stage(batch, "decisions"))
            store.commit(log_id, {"fetch_log": log})
        settle(store, landed, specs, f"{name}:{batch_no}", blank_is_null)

    # Batches without data let timers fire; a run that is to end with the data at hand must not wait for them.
    settings = {
        "spark.sql.streaming.stateStore.providerClass": _ROCKS,
        "spark.sql.streaming.noDataMicroBatches.enabled": str(not once).lower(),
    }
    with _settings(spark, **settings):
        return _start(decided, step, checkpoint, once, every)


def settle(store: TableStore, landed: FetchedPages, specs: list[FeedSpec], name: str, blank_is_null: bool = True) -> None:
    """Merge the decided fetches that have no open fetch before them, earliest first, one commit each.

    A commit takes its decisions out of the log, so what a crash left undone is done by the next call.
    Only rows about whole fetches reach the driver.
    """
    heads = store.read("fetch_log").filter("page_no IS NULL OR what = 'late'").select("feed", "fetched", "mark", "newest", "what")
    heads = heads.distinct().collect()
    over = {(r.feed, r.fetched) for r in heads if r.what in (fetches.CLOSED, fetches.FAILED)}
    still_open = [r.fetched for r in heads if r.what == fetches.OPENED and (r.feed, r.fetched) not in over]
    late = sorted({r.fetched for r in heads if r.what == fetches.LATE})
    ready = sorted({fetched for _, fetched in over if not still_open or fetched < min(still_open)})
    for fetched, what in [*((f, fetches.PAGE) for f in ready), *((f, fetches.LATE) for f in late)]:
        log = store.read("fetch_log")
        of_this = (F.col("fetched") == fetched) & ((F.col("what") == fetches.LATE) == F.lit(what == fetches.LATE))
        pages = log.filter(of_this & (F.col("what") == what)).select("feed", "fetched", "page_no", "upto", "mark").distinct()
        closed = [r for r in heads if r.fetched == fetched and r.what == fetches.CLOSED and what == fetches.PAGE]
        known = [(r.feed, max(t for t in (r.mark, r.newest) if t is not None)) for r in closed if r.mark or r.newest]
        moved = store.spark.createDataFrame(known, "feed string, mark bigint")
        started = datetime.fromtimestamp(fetched / 1_000_000, timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
        publish(
            store, specs, read_items(landed, specs, pages), moved.withColumn("mark", F.timestamp_seconds("mark")), started,
            f"{name}:{fetched}:{what}", blank_is_null=blank_is_null, only_new=what == fetches.LATE, beside={"fetch_log": log.filter(~of_this)},
        )


def read_items(landed: FetchedPages, specs: list[FeedSpec], pages: DataFrame) -> DataFrame:
    """The items that decided ``pages(feed, fetched, page_no, upto, mark)`` let in; only these pages are decoded."""
    place = ["feed", "fetched", "page_no"]
    bodies = landed.read().withColumn("fetched", F.unix_micros("fetched_at")).join(pages.select(*place), place, "left_semi")
    items = feed_source.landed_feeds(specs, bodies, F.col("fetched_at"), ["fetched", "fetched_at"])
    items = feed_source.all_items(items).join(pages, place)
    newer = F.col("mark").isNull() | F.col("ts").isNull() | (F.unix_seconds("ts") > F.col("mark"))
    in_order = F.col("feed").isin([s.name for s in specs if s.rule == feed_source.TAKE_WHILE])
    return items.filter((F.col("pos") < F.col("upto")) & (in_order | newer)).drop("upto", "mark", "fetched", "fetched_at")
