"""Feed sync: landed pages to bookmark table, with marks, orphans and the enrichment gate."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import catalog, incremental
from ..operators.listing import is_stale
from ..operators.skew import near_keys
from ..schema import BOOKMARK_COLUMNS, LAST_REFRESH_KEY
from ..session import observed, stage
from ..sources import feeds as feed_source
from ..sources.feeds import BATCH_ORDER, FeedSpec
from ..sources.tables import Parts, TableStore
from . import enrich as enrich_plan
from . import index as index_plan


@dataclass
class Fetch:
    """What the landed pages contribute: new items, next marks, and which feeds were damaged."""

    rows: DataFrame
    newest: DataFrame
    quarantine: DataFrame
    failed: list[str]
    damaged: list[str]
    landed: list[str]


@dataclass
class SyncResult:
    stats: DataFrame | None = None
    quarantine: DataFrame | None = None
    failed_feeds: list[str] = field(default_factory=list)
    kept_orphans: list[str] = field(default_factory=list)
    new_items: int = 0
    skipped: bool = False
    tally: DataFrame | None = None


def _of_rule(specs: list[FeedSpec], rule: str):
    return F.col("feed").isin([s.name for s in specs if s.rule == rule])


def fetch(specs: list[FeedSpec], pages: DataFrame, marks: DataFrame, batch_time: str, every_page: bool = False) -> Fetch:
    """Decode all pages once, then cut each feed to what is new after its mark.

    Every page that landed before an unreadable one is read, also behind a short or empty page. With ``every_page`` nothing that landed is cut and unreadable pages are only set aside. Only rows
    with one entry per registered feed reach the driver.
    """
    landed = stage(feed_source.landed_feeds(specs, pages, batch_time), "landed")
    read = feed_source.all_items(landed) if every_page else feed_source.reachable(landed, to_end=False)
    if every_page:
        marks = marks.withColumn("mark", F.lit(None).cast(marks.schema["mark"].dataType))
    in_page = read.filter(_of_rule(specs, feed_source.IN_PAGE))
    take = read.filter(_of_rule(specs, feed_source.TAKE_WHILE))
    reach = {r.feed: r for r in feed_source.page_reach(landed).collect()}
    damaged = [s.name for s in specs if s.name in reach and reach[s.name].bad_page is not None]
    failed = [] if every_page else _failed(specs, reach, damaged, in_page, marks)
    rows = incremental.take_while_newer(take, marks, batch_time, few_feeds=True).unionByName(
        incremental.filter_in_page(in_page, marks, few_feeds=True)
    )
    newest = incremental.take_while_marks(take, marks, batch_time, few_feeds=True).unionByName(
        incremental.filter_in_page_marks(in_page, marks, few_feeds=True)
    )
    healthy = ~F.col("feed").isin(failed)
    return Fetch(rows.filter(healthy), newest.filter(healthy), feed_source.quarantine(landed), failed, damaged, list(reach))


def _failed(specs, reach, damaged, in_page, marks) -> list[str]:
    """Feeds that met an unreadable page and give up: on their first page, or on any if ``fail_whole``."""
    failed = []
    for spec in (s for s in specs if s.name in damaged):
        r = reach[spec.name]
        met = r.last_page is None or r.bad_page < r.last_page
        if met and spec.rule == feed_source.IN_PAGE:
            # An earlier page without anything new would have ended the fetch before the bad one.
            stop = incremental.last_visited_pages(in_page, marks, few_feeds=True).filter(F.col("feed") == spec.name).first()
            met = stop is None or stop.last_page is None
        if met and (spec.fail_whole or r.bad_page == r.first_page):
            failed.append(spec.name)
    return failed


def sync(
    store: TableStore,
    pages: DataFrame,
    batch_time: str,
    batch_id: str,
    enabled: Iterable[str] = ("github", "x", "raindrop"),
    requested: Iterable[str] = (),
    force: bool = False,
    reprocess: bool = False,
    blank_is_null: bool = True,
    enrichment: dict | None = None,
    enrich_limit: int | None = None,
    every_page: bool = False,
) -> SyncResult:
    """Merge landed pages into the store and, when something new arrived, enrich the queue.

    A batch id that was committed before is skipped, so a repeated run changes nothing. Rows,
    deletions and marks become visible in one commit, which also notes that the enrichment is due;
    that is a second one, and a repeat of the batch makes up for it if it did not happen. With ``force``
    marks are ignored and rows a feed no longer has are removed, except for feeds of which no page
    landed and feeds with unreadable pages, whose list would be incomplete; a readable page without
    items means an empty feed. ``every_page`` as in ``fetch``. A stored index follows the changed rows.
    """
    run = f"{batch_id}:enrich"
    if store.has_batch(batch_id):
        resumed = enrichment is not None and enrich_plan.is_due(store, run)
        tally = enrich_plan.enrich(store, batch_time, run, enrich_limit, **enrichment) if resumed else None
        return SyncResult(skipped=True, tally=tally)
    specs = feed_source.select_feeds(enabled, requested)
    marks = incremental.marks_from_state(store.read("sync_state"), [s.name for s in specs], force)
    fetched = fetch(specs, pages, marks, batch_time, every_page)
    good = [s for s in specs if s.name not in fetched.failed]
    keep_orphans = [s.name for s in good if s.name in fetched.damaged]
    whole = [s.name for s in good if s.name in fetched.landed and s.name not in keep_orphans]
    result = publish(
        store, good, fetched.rows, incremental.advance_marks(marks, fetched.newest), batch_time, batch_id,
        swept=whole if force else None, reprocess=reprocess, blank_is_null=blank_is_null, due=None if enrichment is None else run,
    )
    result.quarantine, result.failed_feeds = fetched.quarantine, fetched.failed
    result.kept_orphans = keep_orphans if force else []
    if enrichment is not None and (result.new_items > 0 or reprocess):
        result.tally = enrich_plan.enrich(store, batch_time, run, enrich_limit, **enrichment)
    return result


def _per_feed(specs: list[FeedSpec], which: Column) -> list[Column]:
    """For each feed the number of rows of it that satisfy ``which``, to be observed."""
    return [F.count_if(which & (F.col("source") == s.name)).alias(s.name) for s in specs]


def publish(
    store: TableStore,
    specs: list[FeedSpec],
    rows: DataFrame,
    marks: DataFrame,
    batch_time: str,
    batch_id: str,
    swept: list[str] | None = None,
    reprocess: bool = False,
    blank_is_null: bool = True,
    only_new: bool = False,
    beside: dict[str, DataFrame] | None = None,
    due: str | None = None,
) -> SyncResult:
    """Commit feed rows and the next marks; a stored index follows.

    ``swept`` names the feeds whose stored rows go when the feed no longer has them (None: a plain
    merge that reads and replaces the touched buckets only). ``only_new`` leaves stored rows as they are.
    ``beside`` holds further tables that change in the same commit; ``due`` names the enrichment run that is noted
    in it when something new arrived or ``reprocess`` is set. The counters of a plain merge are
    observed while its rows are staged and written; no job reads them for that.
    """
    state = store.read("sync_state")
    plain = swept is None and not reprocess
    seen, added = Observation(), Observation()
    watched = rows.observe(seen, *_per_feed(specs, F.lit(True))) if plain else rows
    # Feeds are collapsed while they are merged; here only their urls and ids are asked for.
    batch = catalog.collapse_batch(watched, BATCH_ORDER, blank_is_null)
    batch = stage(batch if plain and only_new else batch.select("id", "url"), "batch")
    buckets = None if swept is not None else store.touched("bookmarks", batch)
    existing = store.read("bookmarks", buckets)
    if plain and only_new:
        merged = catalog.upsert(existing.limit(0), catalog.fresh(existing, batch), batch_time, blank_is_null)
        merged = merged.observe(added, *_per_feed(specs, F.col("is_new"))).select(*BOOKMARK_COLUMNS)
        written = store.prepare("bookmarks", Parts(existing, merged))
        merged = written.rows
    elif plain:
        whole = catalog.collapse_batch(rows, BATCH_ORDER, blank_is_null)
        near, few = near_keys(batch.select("url"))
        met = existing.join(near, "url", "left_semi") if few else existing
        dealt, merge = catalog.dealt_upsert(met, whole, batch_time, blank_is_null)
        counted = lambda d: merge(d).observe(added, *_per_feed(specs, F.col("is_new")))
        written = store.prepare("bookmarks", Parts(existing.join(near, "url", "left_anti") if few else None, dealt, counted))
        merged = written.rows
    else:
        counts = catalog.upsert_stats(existing, rows, BATCH_ORDER).collect()
        merged = _merge_in_turn(existing, rows, specs, batch_time, swept or [], reprocess, blank_is_null, {c.source for c in counts})
    changes = {"bookmarks": written if plain else merged}
    touched = {} if buckets is None else {"bookmarks": buckets}
    gone = None
    if swept is not None:
        gone = stage(existing.select("id").join(merged.select("id"), "id", "left_anti"), "gone")
        changes["vectors"] = catalog.delete_ids(store.read("vectors"), gone)
    moved = incremental.marks_to_state(marks)
    changes["sync_state"] = catalog.put_state(state, moved.unionByName(_refresh_stamp(store, batch_time)))
    changes |= beside or {}
    if due and (reprocess or not catalog.fresh(existing, batch).isEmpty()):
        changes["enrich_due"] = enrich_plan.due(store, due, batch_time)
    if index_plan.is_current(store):
        ids = catalog.batch_ids(existing, batch)
        changed = ids if gone is None else ids.unionByName(gone)
        index_changes, index_touched = index_plan.changes_for(store, stage(changed, "changed"), merged)
        changes |= index_changes
        touched |= index_touched
    index_plan.with_codes(changes, touched)
    store.commit(batch_id, changes, touched)
    if plain:
        total, new = (observed(counters, [s.name for s in specs]) for counters in (seen, added))
        counts = [(s.name, new[s.name], total[s.name] - new[s.name]) for s in specs if total[s.name]]
    stats = store.spark.createDataFrame(counts, "source string, new_items bigint, skipped_items bigint")
    return SyncResult(stats=stats, new_items=sum(c[1] for c in counts))


def _merge_in_turn(existing, rows, specs, batch_time, swept, reprocess, blank_is_null, given) -> DataFrame:
    """Merge one feed after the other, as deletions and resets of a feed are seen by the next.

    Without either, one merge of all feeds gives the same rows. The merge itself tells which urls it met again and which rows
    of the feed it did not meet, so neither needs a join of its own. A feed without rows that is not swept changes nothing.
    """
    current = existing
    for spec in specs:
        if spec.name not in given and spec.name not in swept:
            continue
        mine = rows.filter(F.col("source") == spec.name)
        batch = stage(catalog.collapse_batch(mine, BATCH_ORDER, blank_is_null), "batch")
        following = catalog.upsert_met(current, batch, batch_time, blank_is_null)
        if spec.name in swept:
            following = following.filter(~F.col("source").eqNullSafe(spec.name) | F.col("changed"))
        if reprocess:
            following = catalog.clear_where(following, F.col("met_again"))
        current = stage(following.select(*BOOKMARK_COLUMNS), "merged")
    return current


def _refresh_stamp(store: TableStore, batch_time: str) -> DataFrame:
    value = incremental.format_rfc3339(F.lit(batch_time).cast("timestamp"))
    return store.spark.range(1).select(F.lit(LAST_REFRESH_KEY).alias("key"), value.alias("value"))


def refresh_due(store: TableStore, now: str) -> bool:
    """The daily gate: whether the last refresh is missing, unreadable or a day old."""
    return bool(is_stale(store.read("sync_state"), now).first().stale)


def _holding(store: TableStore, ids: DataFrame) -> list[int]:
    """Buckets of the bookmark table that hold any of ``ids``; reads the narrow key columns only."""
    keys = store.read("bookmarks").select("id", "url").join(ids.select("id"), "id", "left_semi")
    return store.touched("bookmarks", keys)


def remove(store: TableStore, ids: DataFrame, batch_id: str) -> int:
    """Delete bookmarks with their vectors and index entries in one commit; only buckets that hold them are rewritten."""
    if store.has_batch(batch_id):
        return store.snapshot().version
    near, few = near_keys(stage(ids.select("id").distinct(), "ids"))
    held = _holding(store, near)
    bookmarks = store.read("bookmarks", held).join(near, "id", "left_anti")
    written = store.prepare("bookmarks", Parts(bookmarks) if few else bookmarks)
    buckets = store.touched("vectors", near)
    changes = {"bookmarks": written, "vectors": store.read("vectors", buckets).join(near, "id", "left_anti")}
    touched = {"bookmarks": held, "vectors": buckets}
    if index_plan.is_current(store):
        index_changes, index_touched = index_plan.changes_for(store, near, written.rows)
        changes |= index_changes
        touched |= index_touched
    index_plan.with_codes(changes, touched)
    return store.commit(batch_id, changes, touched)


def edit(store: TableStore, edits: DataFrame, batch_time: str, batch_id: str, limits: dict[str, int] | None = None) -> int:
    """Apply user edits of ``(id, title, summary, keywords, notes)`` to the buckets that hold them; a stored index follows."""
    if store.has_batch(batch_id):
        return store.snapshot().version
    near, few = near_keys(stage(edits.select("id").distinct(), "ids"))
    held = _holding(store, near)
    stored = store.read("bookmarks", held)
    edited = catalog.apply_edits(stored, edits, batch_time, limits, every=few)
    written = store.prepare("bookmarks", Parts(stored.join(near, "id", "left_anti") if few else None, edited))
    changes, touched = {"bookmarks": written}, {"bookmarks": held}
    if index_plan.is_current(store):
        index_changes, index_touched = index_plan.changes_for(store, near, written.rows)
        changes |= index_changes
        touched |= index_touched
    return store.commit(batch_id, changes, touched)
