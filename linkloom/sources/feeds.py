"""Feeds as data: payload schema, paging rules and a normalizer for each.

A feed is a ``FeedSpec`` in ``FEEDS``; registering another one is all a new feed needs. Pages are
decoded once into arrays and never leave Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..functions.times import parse_rfc3339, parse_x_time
from ..operators.skew import computed_once
from ..schema import BOOKMARK_COLUMNS, PENDING
from ..session import timestamp

X_TITLE_BYTES = 100
TAKE_WHILE = "take_while"
IN_PAGE = "in_page"

# A ``]`` followed by ``[`` outside of strings joins two arrays printed back to back. Empty arrays
# vanish into the seam, or at either end of the page.
_SEAM = r'\G((?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"\]]++|\](?!\s*+\[))*+)\]\s*+(?:\[\s*+\]\s*+)*+\['
_EMPTY_FIRST = r"^(?:\[\s*+\]\s*+)++(?=\[)"
_EMPTY_LAST = r"\](?:\s*+\[\s*+\])++\z"


@dataclass(frozen=True)
class FeedSpec:
    """How one feed is read.

    ``list_field`` names the array inside an object page (None: only bare arrays are valid),
    ``cursor_field`` the field whose blank value marks the last page, ``page_size`` the size below
    which a page is the last one. ``fail_whole`` drops the whole feed on an unreadable page; other
    feeds keep the pages before it, unless it is the first.
    """

    name: str
    item_schema: str
    rule: str
    item_time: Callable[[Column], Column]
    fields: Callable[[Column], dict[str, Column]]
    list_field: str | None = None
    cursor_field: str | None = None
    page_size: int | None = None
    joined_arrays: bool = False
    fail_whole: bool = False


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _x_fields(item: Column) -> dict[str, Column]:
    user, post = _text(item["author"]["username"]), _text(item["id"])
    return {
        "url": F.concat(F.lit("https://x.com/"), user, F.lit("/status/"), post),
        "title": snippet(_text(item["text"]), X_TITLE_BYTES),
    }


def join_tags(tags: Column) -> Column:
    """Tags joined by commas; a missing list and missing elements count as blank."""
    present = F.coalesce(tags, F.array().cast("array<string>"))
    return F.array_join(F.transform(present, _text), ",")


def _raindrop_fields(item: Column) -> dict[str, Column]:
    return {
        "url": _text(item["link"]),
        "title": _text(item["title"]),
        "summary": _text(item["excerpt"]),
        "keywords": join_tags(item["tags"]),
        "notes": _text(item["note"]),
    }


def _github_fields(item: Column) -> dict[str, Column]:
    repo = item["repo"]
    return {
        "url": _text(repo["html_url"]),
        "title": _text(repo["full_name"]),
        "summary": _text(repo["description"]),
    }


GITHUB = FeedSpec(
    name="github",
    item_schema="struct<starred_at:string,repo:struct<full_name:string,html_url:string,description:string>>",
    rule=TAKE_WHILE,
    item_time=lambda item: parse_rfc3339(item["starred_at"]),
    fields=_github_fields,
    page_size=100,
    joined_arrays=True,
)
X = FeedSpec(
    name="x",
    item_schema="struct<id:string,text:string,createdAt:string,author:struct<username:string,name:string>>",
    rule=IN_PAGE,
    item_time=lambda item: parse_x_time(item["createdAt"]),
    fields=_x_fields,
    list_field="tweets",
    cursor_field="nextCursor",
    fail_whole=True,
)
RAINDROP = FeedSpec(
    name="raindrop",
    item_schema=(
        "struct<_id:bigint,title:string,link:string,excerpt:string,note:string,created:string,tags:array<string>>"
    ),
    rule=TAKE_WHILE,
    item_time=lambda item: parse_rfc3339(item["created"]),
    fields=_raindrop_fields,
    list_field="items",
    page_size=50,
)

# In the order a sync merges them; it decides which feed a shared url belongs to.
FEEDS: dict[str, FeedSpec] = {spec.name: spec for spec in (GITHUB, X, RAINDROP)}


def register_feed(spec: FeedSpec) -> None:
    FEEDS[spec.name] = spec


def select_feeds(enabled: Iterable[str], requested: Iterable[str] = ()) -> list[FeedSpec]:
    """Enabled feeds that were asked for, in merge order; an empty request means all."""
    on = set(enabled)
    wanted = {name.strip().lower() for name in requested}
    chosen = [spec for name, spec in FEEDS.items() if name in on and (not wanted or name in wanted)]
    if not chosen:
        raise ValueError("no feed is both enabled and requested")
    return chosen


def join_arrays(body: Column) -> Column:
    """Arrays printed back to back as one array; brackets inside strings are left alone."""
    inner = F.regexp_replace(F.regexp_replace(body, _EMPTY_LAST, "]"), _EMPTY_FIRST, "")
    return F.regexp_replace(inner, _SEAM, "$1,")


def decode_pages(spec: FeedSpec, pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``(feed, page_no, *keep, items, cursor, bad, body)`` of one feed; ``body`` is kept for bad pages.

    Whether a page is an array or an object is decided on its first character, because reading
    an object with an array schema yields an array of blanks instead of an error.
    """
    body = F.regexp_replace(F.coalesce(F.col("body"), F.lit("")), r"^\s++|(?<!\s)\s++\z", "")
    place = ["feed", "page_no", *keep]
    page = computed_once(pages.filter(F.col("feed") == spec.name), place, {"body": body})
    items = f"array<{spec.item_schema}>"
    is_array = F.col("body").startswith("[") & F.col("body").endswith("]")
    joined = join_arrays(F.col("body"))
    bare = F.from_json(joined if spec.joined_arrays else F.col("body"), items)
    parsed = {"bare": F.when(is_array, bare)}
    array_ok = F.col("bare").isNotNull()
    if not spec.joined_arrays:
        parsed["seam"] = is_array & F.col("body").rlike(_SEAM)
        array_ok = array_ok & ~F.col("seam")
    ok = (is_array & array_ok) | (F.col("body") == "null")
    found, cursor = F.col("bare"), F.lit("")
    if spec.list_field:
        cursor_field = f", {spec.cursor_field}: string" if spec.cursor_field else ""
        schema = f"struct<{spec.list_field}: {items}{cursor_field}, _bad: string>"
        is_object = F.col("body").startswith("{") & F.col("body").endswith("}")
        whole = F.from_json("body", schema, {"columnNameOfCorruptRecord": "_bad"})
        parsed["whole"] = F.when(is_object, whole)
        ok = ok | (is_object & F.col("whole").isNotNull() & F.col("whole._bad").isNull())
        found = F.coalesce(found, F.col(f"whole.{spec.list_field}"))
        if spec.cursor_field:
            cursor = _text(F.col(f"whole.{spec.cursor_field}"))
    return computed_once(
        computed_once(page, [*place, "body"], parsed),
        place,
        {
            "items": F.when(ok, F.coalesce(found, F.array().cast(items))).otherwise(F.array().cast(items)),
            "cursor": cursor,
            "bad": ~ok,
            "body": F.when(~ok, F.col("body")),
        },
    )


def ends_fetch(spec: FeedSpec) -> Column:
    """Whether a decoded page is readable and the last one a fetch would read."""
    ends = F.size("items") == 0
    if spec.page_size:
        ends = ends | (F.size("items") < spec.page_size)
    if spec.cursor_field:
        ends = ends | (F.col("cursor") == "")
    return ~F.col("bad") & ends


def page_times(spec: FeedSpec, pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``(feed, page_no, *keep, bad, ends, secs)``: all that paging rules ask of a page, without its texts.

    ``secs`` are the times of its items in whole seconds, NULL where an item has none.
    """
    secs = F.transform("items", lambda item: F.unix_seconds(spec.item_time(item)))
    decoded = decode_pages(spec, pages, keep)
    return decoded.select("feed", "page_no", *keep, "bad", ends_fetch(spec).alias("ends"), secs.alias("secs"))


def landed_rows(spec: FeedSpec, pages: DataFrame, batch_time: str | Column, keep: Sequence[str] = ()) -> DataFrame:
    """The items of one feed as pending bookmark rows, with all a later stage needs of their page.

    Page columns are ``feed, page_no, bad, ends`` (the page is the last one a fetch would read) and
    ``body`` (unreadable pages only); ``pos, ts`` place the item. A page without items keeps one
    row with a NULL ``pos``. ``keep`` names further page columns, which ``batch_time`` may use.
    """
    decoded = decode_pages(spec, pages, keep)
    items = decoded.select("feed", "page_no", *keep, "bad", ends_fetch(spec).alias("ends"), "body", F.posexplode_outer("items"))
    items = items.withColumnRenamed("col", "item").withColumn("ts", spec.item_time(F.col("item")))
    given = spec.fields(F.col("item"))
    values = {
        "id": F.lit(""),
        "source": F.lit(spec.name),
        **dict.fromkeys(("summary", "keywords", "notes", "raw_content"), F.lit("")),
        **given,
        "created_at": F.coalesce(F.col("ts"), timestamp(batch_time)),
        "updated_at": timestamp(batch_time),
        "scraped_at": F.lit(None).cast("timestamp"),
        "scrape_status": F.lit(PENDING),
        "hidden": F.lit(False),
    }
    return items.select(*PAGE_COLUMNS, *keep, *[values[c].alias(c) for c in BOOKMARK_COLUMNS])


PAGE_COLUMNS = ("feed", "page_no", "bad", "ends", "body", "pos", "ts")


def landed_feeds(specs: list[FeedSpec], pages: DataFrame, batch_time: str | Column, keep: Sequence[str] = ()) -> DataFrame:
    """``landed_rows`` of several feeds; ``source_order`` is the place of the feed in the merge."""
    parts = [landed_rows(spec, pages, batch_time, keep).withColumn("source_order", F.lit(i)) for i, spec in enumerate(specs)]
    return reduce(DataFrame.unionByName, parts)


def quarantine(landed: DataFrame) -> DataFrame:
    """Pages that could not be read."""
    return landed.filter("bad").select("feed", "page_no", "body")


def page_reach(landed: DataFrame) -> DataFrame:
    """Per feed: ``last_page``, the last page a fetch would read, ``bad_page``, the first unreadable one, ``first_page``."""
    return landed.groupBy("feed").agg(
        F.min(F.when(F.col("ends"), F.col("page_no"))).alias("last_page"),
        F.min(F.when(F.col("bad"), F.col("page_no"))).alias("bad_page"),
        F.min("page_no").alias("first_page"),
    )


def all_items(landed: DataFrame) -> DataFrame:
    """The items of every readable page."""
    return landed.filter(F.col("pos").isNotNull()).drop("bad", "ends", "body")


def reachable(landed: DataFrame, to_end: bool = True) -> DataFrame:
    """The items before the first bad page of their feed and, with ``to_end``, up to its last page.

    The last page is where a client that fetches page by page would stop: a short or empty one, or one without
    a cursor. One row per registered feed is broadcast.
    """
    reach = page_reach(landed).select("feed", "last_page", "bad_page")
    read = landed.filter(F.col("pos").isNotNull()).join(F.broadcast(reach), "feed")
    good = F.col("bad_page").isNull() | (F.col("page_no") < F.col("bad_page"))
    if to_end:
        good = good & (F.col("last_page").isNull() | (F.col("page_no") <= F.col("last_page")))
    return read.filter(good).drop("last_page", "bad_page", "bad", "ends", "body")


BATCH_ORDER = ["source_order", "page_no", "pos"]
