"""Changes to the bookmark table, each as a DataFrame of the next table state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..schema import BOOKMARK_COLUMNS, PENDING, SUCCESS
from ..session import timestamp
from ..sources.tables import DEALT

CONTENT_COLUMNS = ("title", "summary", "keywords", "notes", "raw_content")

# Longest user-editable values, in characters, of an editor that limits its fields.
EDIT_LIMITS = {"title": 256, "summary": 500, "keywords": 256, "notes": 500}

MERGE_COLUMNS = (*CONTENT_COLUMNS, "scraped_at", "scrape_status")


def collapse_batch(incoming: DataFrame, order: list[str], blank_is_null: bool = True) -> DataFrame:
    """One row per url, as if the batch had been upserted row by row in ``order``.

    The first row of a url gives id, source, created_at and hidden; every other column takes its
    last non-NULL value. Both are aggregates with map-side combine, so a url that fills a third
    of the batch costs one row per input partition after the first stage.
    """
    position = F.struct(*order)
    cleaned = incoming.withColumn("id", F.coalesce(F.nullif(F.col("id"), F.lit("")), stable_id(F.col("url"))))
    if blank_is_null:
        for c in CONTENT_COLUMNS:
            cleaned = cleaned.withColumn(c, F.nullif(F.col(c), F.lit("")))
    first = F.min_by(F.struct("id", "source", "created_at", "hidden"), position).alias("_first")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(c) for c in MERGE_COLUMNS]
    return (
        cleaned.groupBy("url")
        .agg(first, *last, F.count("*").alias("batch_rows"))
        .select("_first.*", "url", *MERGE_COLUMNS, "batch_rows")
    )


def upsert(
    existing: DataFrame, batch: DataFrame, batch_time: str | Column, blank_is_null: bool = True
) -> DataFrame:
    """Merge a collapsed batch into ``existing`` by url, adding ``is_new`` and ``changed``.

    ``blank_is_null=False`` lets blank incoming text and any incoming status overwrite what is
    stored; True keeps stored text where the feed has none and keeps a finished row finished.

    Known urls are patched through a left join, new ones appended after an anti join with the urls
    the batch shares with the table. The batch is the inner side of every join with the table, so one
    small enough to broadcast never shuffles a stored column.
    """
    return upsert_met(existing, batch, batch_time, blank_is_null).drop("met_again")


def upsert_met(
    existing: DataFrame, batch: DataFrame, batch_time: str | Column, blank_is_null: bool = True
) -> DataFrame:
    """``upsert`` with ``met_again``: whether it met the row's url as a known one, stored or seen twice (``repeated_urls``)."""
    now = timestamp(batch_time)
    news = batch.select(F.col("url"), *[F.col(c).alias(f"_{c}") for c in MERGE_COLUMNS], F.lit(True).alias("_hit"))
    joined = existing.select(*BOOKMARK_COLUMNS).join(news, "url", "left")
    hit = F.col("_hit").isNotNull()
    merged = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in MERGE_COLUMNS}
    if blank_is_null:
        done = F.col("scrape_status") == SUCCESS
        merged["scrape_status"] = F.when(done, F.col("scrape_status")).otherwise(merged["scrape_status"])
    merged["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
    kept = joined.select(
        *[merged.get(c, F.col(c)).alias(c) for c in BOOKMARK_COLUMNS],
        F.lit(False).alias("is_new"),
        hit.alias("changed"),
        hit.alias("met_again"),
    )
    twice = F.col("batch_rows") > 1 if "batch_rows" in batch.columns else F.lit(False)
    unknown = fresh(existing, batch)
    added = unknown.select(*_filled(now), F.lit(True).alias("is_new"), F.lit(True).alias("changed"), twice.alias("met_again"))
    return kept.unionByName(added)


def dealt_upsert(
    existing: DataFrame, batch: DataFrame, batch_time: str | Column, blank_is_null: bool = True
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``upsert`` in the shuffle that a write needs anyway: what is dealt by url, and what merges it there.

    Stored and new rows of a url meet where they are written, so no text travels for a join before.
    """
    now = timestamp(batch_time)
    columns = [c for c in BOOKMARK_COLUMNS if c in batch.columns]
    both = existing.select(*BOOKMARK_COLUMNS).withColumn("_new", F.lit(False)).unionByName(
        batch.select(*columns).withColumn("_new", F.lit(True)), allowMissingColumns=True
    )

    def merge(dealt: DataFrame) -> DataFrame:
        own = Window.partitionBy(*DEALT, "url")
        new = F.col("_new")
        news = F.first(F.when(new, F.struct(*MERGE_COLUMNS)), ignorenulls=True).over(own)
        rows = dealt.withColumns({"_news": news, "_known": F.bool_or(~new).over(own)}).filter(~(new & F.col("_known")))
        hit = F.col("_news").isNotNull() & ~new
        stored = {c: F.coalesce(F.when(hit, F.col(f"_news.{c}")), F.col(c)) for c in MERGE_COLUMNS}
        if blank_is_null:
            stored["scrape_status"] = F.when(F.col("scrape_status") == SUCCESS, F.col("scrape_status")).otherwise(stored["scrape_status"])
        stored["updated_at"] = F.when(hit, now).otherwise(F.col("updated_at"))
        added = _fillings(now)
        values = {c: F.when(new, added.get(c, F.col(c))).otherwise(stored.get(c, F.col(c))) for c in {*added, *stored}}
        return rows.select(*[values.get(c, F.col(c)).alias(c) for c in BOOKMARK_COLUMNS], *DEALT, new.alias("is_new"))

    return both, merge


def known_urls(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """``url, id`` of the stored rows whose url is in the batch.

    The stored side streams past the batch's urls: a broadcast when they are few, and then no
    exchange holds a stored row that the batch does not name.
    """
    return existing.select("url", "id").join(batch.select("url"), "url", "left_semi")


def fresh(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of a collapsed batch whose url is not stored yet."""
    return batch.join(known_urls(existing, batch).select("url"), "url", "left_anti")


def new_rows(existing: DataFrame, batch: DataFrame, batch_time: str | Column) -> DataFrame:
    """The rows of a collapsed batch whose url is not stored yet, ready for the table."""
    return fresh(existing, batch).select(*_filled(timestamp(batch_time)))


def _filled(now: Column) -> list[Column]:
    filled = _fillings(now)
    return [filled.get(c, F.col(c)).alias(c) for c in BOOKMARK_COLUMNS]


def _fillings(now: Column) -> dict[str, Column]:
    filled = {c: F.coalesce(F.col(c), F.lit("")) for c in CONTENT_COLUMNS}
    filled |= {
        "created_at": F.coalesce(F.col("created_at"), now),
        "updated_at": now,
        "scrape_status": F.coalesce(F.col("scrape_status"), F.lit(PENDING)),
        "hidden": F.coalesce(F.col("hidden"), F.lit(False)),
    }
    return filled


def upsert_stats(existing: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """New and skipped rows per source, counting as a row-by-row upsert would.

    The first row of an unknown url is new; every other row is skipped.
    """
    urls = incoming.groupBy("url").agg(F.min_by("source", F.struct(*order)).alias("source"))
    first = (
        urls.join(known_urls(existing, urls).select("url"), "url", "left_anti")
        .groupBy("source")
        .agg(F.count("*").alias("new_items"))
    )
    rows = incoming.groupBy("source").agg(F.count("*").alias("total_items"))
    new_items = F.coalesce(F.col("new_items"), F.lit(0))
    return rows.join(first, "source", "left").select(
        "source", new_items.alias("new_items"), (F.col("total_items") - new_items).alias("skipped_items")
    )


def repeated_urls(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Urls of a collapsed batch that an upsert meets as known: stored, or seen twice."""
    stored = known_urls(existing, batch).select("url")
    return stored.union(batch.filter(F.col("batch_rows") > 1).select("url")).distinct()


def batch_ids(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Ids of the rows a collapsed batch touches: the stored id where the url is known."""
    stored = known_urls(existing, batch).withColumnRenamed("id", "_stored")
    return batch.select("id", "url").join(stored, "url", "left").select(F.coalesce("_stored", "id").alias("id"))


def orphans(existing: DataFrame, current: DataFrame, source: str) -> DataFrame:
    """Stored rows of ``source``, hidden ones included, whose url the feed no longer has."""
    mine = existing.filter(F.col("source") == source)
    return mine.join(current.select("url").distinct(), "url", "left_anti").select("id", "source", "url", "title")


def delete_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """``table`` (bookmarks, vectors or an index part) without the rows of ``ids``."""
    return table.join(ids.select("id").distinct(), "id", "left_anti")


def patch_rows(
    bookmarks: DataFrame, patch: DataFrame, batch_time: str | Column | None = None, every: bool = False
) -> DataFrame:
    """Replace the columns named in ``patch`` for its ids; unknown ids change nothing.

    ``batch_time`` stamps the changed rows; leave it out to keep ``updated_at``. The patch holds
    at most one row per id. ``every`` says that it has one for each of the rows, so what it replaces is not read.
    """
    columns = [c for c in patch.columns if c != "id"]
    renamed = patch.select("id", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_hit"))
    hit = F.col("_hit").isNotNull()
    values = {c: F.col(f"_{c}") if every else F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    if batch_time is not None:
        values["updated_at"] = F.when(hit, timestamp(batch_time)).otherwise(F.col("updated_at"))
    return bookmarks.join(renamed, "id", "inner" if every else "left").select(
        *[values.get(c, F.col(c)).alias(c) for c in bookmarks.columns]
    )


def apply_edits(
    bookmarks: DataFrame, edits: DataFrame, batch_time: str | Column, limits: dict[str, int] | None = None, every: bool = False
) -> DataFrame:
    """User edits of title, summary, keywords and notes; ``limits`` (``EDIT_LIMITS``) cuts the values; ``every`` as in ``patch_rows``."""
    limits = limits or {}
    given = [c for c in EDIT_LIMITS if c in edits.columns]
    values = [F.left(F.col(c), F.lit(limits[c])).alias(c) if c in limits else F.col(c) for c in given]
    return patch_rows(bookmarks, edits.select("id", *values), batch_time, every)


def mark_for_reprocess(bookmarks: DataFrame, keys: DataFrame, on: str = "id") -> DataFrame:
    """Back to pending with blank page text, summary and keywords; the times stay."""
    return _clear(bookmarks, keys, on, {})


def reset_for_reprocess(bookmarks: DataFrame, ids: DataFrame, batch_time: str | Column) -> DataFrame:
    """As ``mark_for_reprocess``, also forgetting the scrape time and stamping the row."""
    return _clear(bookmarks, ids, "id", reset_times(batch_time))


def reset_times(batch_time: str | Column) -> dict[str, Column]:
    return {"scraped_at": F.lit(None).cast("timestamp"), "updated_at": timestamp(batch_time)}


def _clear(bookmarks: DataFrame, keys: DataFrame, on: str, extra: dict[str, Column]) -> DataFrame:
    flags = keys.select(on).distinct().withColumn("_hit", F.lit(True))
    return clear_where(bookmarks.join(flags, on, "left"), F.col("_hit").isNotNull(), extra).select(*bookmarks.columns)


def clear_where(bookmarks: DataFrame, hit: Column, extra: dict[str, Column] | None = None) -> DataFrame:
    """Rows with ``hit`` as ``mark_for_reprocess`` leaves them, decided by the row itself."""
    values = {"scrape_status": F.lit(PENDING), **dict.fromkeys(("raw_content", "summary", "keywords"), F.lit("")), **(extra or {})}
    return bookmarks.select(
        *[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in bookmarks.columns]
    )


def manual_rows(existing: DataFrame, urls: DataFrame, batch_time: str | Column) -> DataFrame:
    """Pending rows for urls not stored yet; the title starts out as the url."""
    now = timestamp(batch_time)
    wanted = urls.select("url").distinct()
    unknown = fresh(existing, wanted)
    blank = F.lit("")
    values = {
        "id": stable_id(F.col("url")),
        "source": F.lit("manual"),
        "title": F.col("url"),
        **dict.fromkeys(("summary", "keywords", "notes", "raw_content"), blank),
        "created_at": now,
        "updated_at": now,
        "scraped_at": F.lit(None).cast("timestamp"),
        "scrape_status": F.lit(PENDING),
        "hidden": F.lit(False),
    }
    return unknown.select(*[values.get(c, F.col(c)).alias(c) for c in BOOKMARK_COLUMNS])


def already_stored(existing: DataFrame, urls: DataFrame) -> DataFrame:
    """The urls a manual add rejects."""
    return known_urls(existing, urls).select("url").distinct()


def replace_by_key(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` take the place of the stored rows with the same key."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.select(*table.columns))


def put_vectors(vectors: DataFrame, rows: DataFrame) -> DataFrame:
    return replace_by_key(vectors, rows, "id")


def put_state(sync_state: DataFrame, rows: DataFrame) -> DataFrame:
    return replace_by_key(sync_state, rows, "key")


def id_collisions(bookmarks: DataFrame) -> DataFrame:
    """Ids shared by different urls; expected to be empty."""
    return bookmarks.groupBy("id").agg(F.count_distinct("url").alias("urls")).filter("urls > 1")
