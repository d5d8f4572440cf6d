"""Which items of a paged feed are new since the saved mark.

Items carry ``feed, page_no, pos, ts`` with ``ts`` NULL where the feed gave no usable time. Marks
carry ``feed, mark`` with NULL for a full fetch. Positions are compared as ``(page_no, pos)``
structs, so no global numbering (and no window over a whole feed) is needed: each rule is one
aggregate per feed with map-side combine, joined back to the items.

``few_feeds`` says that the feeds are the registered ones, so that a table with one row per feed
is small and may be broadcast. Without it the join is salted, and one feed may hold any share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import format_rfc3339, parse_rfc3339, to_second
from ..schema import mark_key
from ..session import timestamp
from .skew import salted_join


def _seq() -> Column:
    return F.struct("page_no", "pos")


def _attach(rows: DataFrame, per_feed: DataFrame, few_feeds: bool, spread: str = "pos") -> DataFrame:
    if few_feeds:
        return rows.join(F.broadcast(per_feed), "feed", "left")
    return salted_join(rows, per_feed, "feed", spread, "left")


def _with_marks(items: DataFrame, marks: DataFrame, few_feeds: bool) -> DataFrame:
    return _attach(items, marks.select("feed", "mark"), few_feeds)


def _take_bounds(items: DataFrame, marks: DataFrame, batch_time: str | Column, few_feeds: bool) -> DataFrame:
    """Per feed: position of the first item not after the mark, NULL if there is none.

    Items are folded by page first, on plain numbers; only one row per page is compared as a place.
    """
    eff = to_second(F.coalesce(F.col("ts"), timestamp(batch_time)))
    pages = (
        _with_marks(items, marks, few_feeds)
        .groupBy("feed", "page_no")
        .agg(F.min(F.when(eff <= F.col("mark"), F.col("pos"))).alias("pos"))
    )
    return pages.groupBy("feed").agg(F.min(F.when(F.col("pos").isNotNull(), _seq())).alias("first_old"))


def take_while_newer(
    items: DataFrame, marks: DataFrame, batch_time: str | Column, few_feeds: bool = False
) -> DataFrame:
    """Items before the first one that is not newer than the mark; an undated item counts as now."""
    bounds = _take_bounds(items, marks, batch_time, few_feeds)
    cut = _attach(items, bounds, few_feeds)
    return cut.filter(F.col("first_old").isNull() | (_seq() < F.col("first_old"))).drop("first_old")


def take_while_marks(
    items: DataFrame, marks: DataFrame, batch_time: str | Column, few_feeds: bool = False
) -> DataFrame:
    """Newest visited time per feed under ``take_while_newer``, the stopping item included."""
    bounds = _take_bounds(items, marks, batch_time, few_feeds)
    eff = to_second(F.coalesce(F.col("ts"), timestamp(batch_time)))
    cut = _attach(items, bounds, few_feeds)
    visited = cut.filter(F.col("first_old").isNull() | (_seq() <= F.col("first_old")))
    return visited.groupBy("feed").agg(F.max(eff).alias("newest"))


def _page_flags(items: DataFrame, marks: DataFrame, few_feeds: bool) -> DataFrame:
    """Per page: whether every item is dated and not after the mark, and the newest time."""
    old = F.coalesce(to_second(F.col("ts")) <= F.col("mark"), F.lit(False))
    return (
        _with_marks(items, marks, few_feeds)
        .groupBy("feed", "page_no")
        .agg(F.bool_and(old).alias("all_old"), F.max(to_second(F.col("ts"))).alias("page_newest"))
    )


def _last_pages(pages: DataFrame) -> DataFrame:
    return pages.groupBy("feed").agg(F.min(F.when(F.col("all_old"), F.col("page_no"))).alias("last_page"))


def last_visited_pages(items: DataFrame, marks: DataFrame, few_feeds: bool = False) -> DataFrame:
    """``(feed, last_page)``: the all-old page where ``filter_in_page`` stops, NULL if there is none."""
    return _last_pages(_page_flags(items, marks, few_feeds))


def filter_in_page(items: DataFrame, marks: DataFrame, few_feeds: bool = False) -> DataFrame:
    """Undated and newer items of every page up to the first page holding neither."""
    last = last_visited_pages(items, marks, few_feeds)
    cut = _attach(items, last.join(marks.select("feed", "mark"), "feed", "left"), few_feeds)
    in_reach = F.col("last_page").isNull() | (F.col("page_no") <= F.col("last_page"))
    newer = F.col("mark").isNull() | F.col("ts").isNull() | (to_second(F.col("ts")) > F.col("mark"))
    return cut.filter(in_reach & newer).drop("last_page", "mark")


def filter_in_page_marks(items: DataFrame, marks: DataFrame, few_feeds: bool = False) -> DataFrame:
    """Newest dated item per feed over the pages ``filter_in_page`` visits."""
    pages = _page_flags(items, marks, few_feeds)
    cut = _attach(pages, _last_pages(pages), few_feeds, "page_no")
    visited = cut.filter(F.col("last_page").isNull() | (F.col("page_no") <= F.col("last_page")))
    return visited.groupBy("feed").agg(F.max("page_newest").alias("newest"))


def advance_marks(marks: DataFrame, newest: DataFrame, never_back: bool = True) -> DataFrame:
    """Next marks: the newest visited time, or the old mark where nothing dated was visited.

    ``never_back=False`` lets a full fetch move a mark backwards.
    """
    both = marks.select("feed", "mark").join(newest.select("feed", "newest"), "feed", "full")
    ahead = F.greatest("mark", "newest") if never_back else F.coalesce("newest", "mark")
    return both.select("feed", ahead.alias("mark"))


def marks_from_state(sync_state: DataFrame, feeds: list[str], force: bool = False) -> DataFrame:
    """Saved marks of ``feeds``; missing or unreadable ones, and all of them on force, are NULL."""
    keyed = [(f, mark_key(f)) for f in feeds]
    names = sync_state.sparkSession.createDataFrame(keyed, "feed string, key string")
    value = F.lit(None).cast("timestamp") if force else parse_rfc3339(F.col("value"))
    return names.join(sync_state, "key", "left").select("feed", value.alias("mark"))


def marks_to_state(marks: DataFrame) -> DataFrame:
    """Marks as sync-state rows."""
    key = F.concat("feed", F.lit("_last_sync_ts"))
    return marks.filter(F.col("mark").isNotNull()).select(key.alias("key"), format_rfc3339(F.col("mark")).alias("value"))
