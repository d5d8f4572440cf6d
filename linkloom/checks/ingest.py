"""Registered feed, merge, sync and streaming queries with their SQL twins.

Feed pages are made by packing whole tables into the page formats of the feeds and are then read
back through the same code that reads landed pages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import format_rfc3339
from ..operators import catalog, incremental, listing
from ..plans.sync import sync
from ..schema import BOOKMARK_COLUMNS, LAST_REFRESH_KEY
from ..session import scratch_path, stage
from ..sources import feeds, landing, page_source
from ..sources.tables import TableStore, default_tables
from ..streaming import sync as stream
from .browse import NOW_SQL, _slim, _slim_sql
from .scalar import sql_snippet
from .views import BATCH_TIME, doc_url, documents, shown_time, sql_id, sql_time, table, with_shown_times

BUCKETS = 4


def _doc_time(doc: Column) -> Column:
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return F.timestamp_seconds(start + doc * 60)


def _undated(doc: Column) -> Column:
    return doc % 13 == 0


def _doc_link(doc: Column) -> Column:
    return F.concat(F.lit("https://example.org/d/"), doc.cast("string"))


#: Documents that travel together; pages of all feeds are cut from them.
GROUP = 100


def _packed(rows: DataFrame, item: Callable[[Column], Column], size: int) -> DataFrame:
    """``(page_no, items)`` with ``size`` items to a page in document order; ``size`` divides ``GROUP``.

    Whole documents are grouped, and pages made from a group: the feeds then have one shuffle between them.
    """
    doc = F.struct("doc_id", "text", "lang", "source").alias("doc")
    groups = rows.select((F.col("doc_id") / GROUP).cast("int").alias("group"), doc).groupBy("group").agg(F.collect_list("doc").alias("docs"))
    page = lambda d: (d["doc_id"] / size).cast("int")
    pages = groups.select("docs", F.explode(F.array_distinct(F.transform("docs", page))).alias("page_no"))
    own = F.filter("docs", lambda d: page(d).eqNullSafe(F.col("page_no")))
    placed = F.transform(own, lambda d: F.struct(d["doc_id"].alias("doc_id"), item(d).alias("item")))
    return pages.select("page_no", F.transform(F.array_sort(placed), lambda e: e["item"]).alias("items"))


def x_pages(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Object pages with a cursor that runs out on the last page."""
    docs = documents(spark, sf_dir).filter(where)

    def item(d: Column) -> Column:
        when = F.when(_undated(d["doc_id"]), "soon").otherwise(F.date_format(_doc_time(d["doc_id"]), "EEE MMM dd HH:mm:ss Z yyyy"))
        author = F.struct(d["source"].alias("username"), d["lang"].alias("name"))
        return F.struct(d["doc_id"].cast("string").alias("id"), d["text"].alias("text"), when.alias("createdAt"), author.alias("author"))

    pages = _packed(docs, item, 100)
    last = docs.agg((F.max("doc_id") / 100).cast("int").alias("last"))
    cursor = F.when(F.col("page_no") < F.col("last"), F.concat(F.lit("c"), F.col("page_no").cast("string")))
    body = F.to_json(F.struct(F.col("items").alias("tweets"), F.coalesce(cursor, F.lit("")).alias("nextCursor")))
    return pages.withColumn("last", last.scalar()).select(F.lit("x").alias("feed"), "page_no", body.alias("body"))


def raindrop_pages(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Bare arrays and object pages in turn."""
    docs = documents(spark, sf_dir).filter(where)

    def item(d: Column) -> Column:
        created = F.when(_undated(d["doc_id"]), "").otherwise(format_rfc3339(_doc_time(d["doc_id"])))
        return F.struct(
            d["doc_id"].alias("_id"),
            F.concat(F.lit("doc "), d["doc_id"].cast("string")).alias("title"),
            _doc_link(d["doc_id"]).alias("link"),
            F.when(d["doc_id"] % 5 == 0, "").otherwise(d["text"]).alias("excerpt"),
            d["source"].alias("note"),
            created.alias("created"),
            F.array(d["lang"], d["source"]).alias("tags"),
        )

    bare, whole = F.to_json("items"), F.to_json(F.struct("items"))
    body = F.when(F.col("page_no") % 2 == 0, bare).otherwise(whole)
    return _packed(docs, item, 50).select(F.lit("raindrop").alias("feed"), "page_no", body.alias("body"))


def github_pages(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """Every page printed as two arrays back to back."""
    docs = documents(spark, sf_dir).filter(where)

    def item(d: Column) -> Column:
        starred = F.when(_undated(d["doc_id"]), "never").otherwise(format_rfc3339(_doc_time(d["doc_id"])))
        repo = F.struct(
            F.concat(d["source"], F.lit("/"), d["doc_id"].cast("string")).alias("full_name"),
            _doc_link(d["doc_id"]).alias("html_url"),
            F.when(d["doc_id"] % 3 > 0, d["text"]).alias("description"),
        )
        return F.struct(starred.alias("starred_at"), repo.alias("repo"))

    pages = _packed(docs, item, 100)
    body = F.concat(F.to_json(F.slice("items", 1, 60)), F.lit("\n "), F.to_json(F.slice("items", 61, 100)))
    return pages.select(F.lit("github").alias("feed"), "page_no", body.alias("body"))


def all_pages(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    parts = [pages(spark, sf_dir, where) for pages in (x_pages, raindrop_pages, github_pages)]
    return parts[0].union(parts[1]).union(parts[2])


def _normalized(spec: feeds.FeedSpec, pages: DataFrame) -> DataFrame:
    return feeds.reachable(feeds.landed_rows(spec, pages, BATCH_TIME))


def feed_normalize_x(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _normalized(feeds.X, x_pages(spark, sf_dir))
    return with_shown_times(rows.select("url", "source", "title", "created_at", "scrape_status", "page_no", "pos"))


def feed_normalize_raindrop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _normalized(feeds.RAINDROP, raindrop_pages(spark, sf_dir)).withColumn("summary", F.md5("summary"))
    return with_shown_times(rows.select("url", "source", "title", "summary", "keywords", "notes", "created_at", "page_no", "pos"))


def feed_normalize_github(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _normalized(feeds.GITHUB, github_pages(spark, sf_dir)).withColumn("summary", F.md5("summary"))
    return with_shown_times(rows.select("url", "source", "title", "summary", "created_at", "page_no", "pos"))


def feed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feeds merged into an empty catalog: two of them carry the same urls."""
    pages = all_pages(spark, sf_dir)
    landed = feeds.landed_feeds(feeds.select_feeds(feeds.FEEDS), pages, BATCH_TIME)
    batch = catalog.collapse_batch(feeds.reachable(landed), feeds.BATCH_ORDER)
    return _slim(catalog.new_rows(_empty(spark), batch, BATCH_TIME))


def _empty(spark: SparkSession) -> DataFrame:
    from ..schema import BOOKMARK_SCHEMA

    return spark.createDataFrame([], BOOKMARK_SCHEMA)


def new_store(spark: SparkSession) -> TableStore:
    return TableStore(spark, scratch_path(spark, "store"), default_tables(BUCKETS))


def sync_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: pages to a stored catalog, then a repeat that must change nothing."""
    store = new_store(spark)
    pages = all_pages(spark, sf_dir)
    sync(store, pages, BATCH_TIME, "first")
    sync(store, pages, BATCH_TIME, "first")
    return _slim(store.read("bookmarks"))


def sync_short_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are all short, of a feed without cursors too: what landed behind them is stored all the same."""
    pages = all_pages(spark, sf_dir, "doc_id % 7 > 0")
    blank = F.regexp_replace("body", r'"nextCursor":"[^"]*"', '"nextCursor":""')
    store = new_store(spark)
    sync(store, pages.withColumn("body", F.when(F.col("feed") == "x", blank).otherwise(F.col("body"))), BATCH_TIME, "short")
    return _slim(store.read("bookmarks"))


def sync_store_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks and refresh time after a sync."""
    store = new_store(spark)
    sync(store, all_pages(spark, sf_dir), BATCH_TIME, "first")
    return store.read("sync_state")


# --- incremental rules ------------------------------------------------------------------------

_DAY_US = 86_400_000_000
_END_US = 1_706_745_600_000_000  # 2024-02-01T00:00:00Z


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as feed items, newest first, one page per day; each user is a feed.

    Errors carry no time, and signups one that is six days older than their place in the feed.
    """
    ts = F.col("ts").cast("timestamp")
    back = F.lit(_END_US) - F.unix_micros(ts)
    given = F.when(F.col("event_type") == "signup", ts - F.expr("INTERVAL 6 DAYS")).when(F.col("event_type") != "error", ts)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("feed"),
        (back / _DAY_US).cast("int").alias("page_no"),
        (back % _DAY_US).alias("pos"),
        given.alias("ts"),
        "event_id",
    )


def event_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved mark for every user, none for every seventh."""
    start = F.unix_timestamp(F.lit("2024-01-08 00:00:00").cast("timestamp"))
    mark = F.timestamp_seconds(start + (F.col("user_id") % 15) * 86400)
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.lit(1).alias("one"))
    return users.select(F.col("user_id").cast("string").alias("feed"), F.when(F.col("user_id") % 7 > 0, mark).alias("mark"))


def incremental_take_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incremental.take_while_newer(event_items(spark, sf_dir), event_marks(spark, sf_dir), BATCH_TIME)
    return rows.select("feed", "event_id")


def incremental_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.filter_in_page(event_items(spark, sf_dir), event_marks(spark, sf_dir)).select("feed", "event_id")


def sync_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next marks of every feed under both rules."""
    items, marks = event_items(spark, sf_dir), event_marks(spark, sf_dir)
    by_rule = {
        "take_while": incremental.take_while_marks(items, marks, BATCH_TIME),
        "in_page": incremental.filter_in_page_marks(items, marks),
    }
    parts = [
        incremental.advance_marks(marks, newest).select(F.lit(rule).alias("rule"), "feed", shown_time("mark").alias("mark"))
        for rule, newest in by_rule.items()
    ]
    return parts[0].union(parts[1])


# --- merging ----------------------------------------------------------------------------------

_SPLIT = "2024-01-16 00:00:00"


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bookmark rows: a url is seen again by later events, in other feeds too."""
    return _event_rows(table(spark, sf_dir, "events"))


def _event_rows(events: DataFrame) -> DataFrame:
    ts, n = F.col("ts").cast("timestamp"), F.col("event_id")
    kind = F.col("event_type")
    values = {
        "id": F.lit(""),
        "source": F.element_at(F.array(F.lit("github"), F.lit("x"), F.lit("raindrop")), (n % 3 + 1).cast("int")),
        "url": F.concat(
            F.lit("https://example.org/u/"), F.col("user_id").cast("string"), F.lit("/"), kind, F.lit("/"), F.hour(ts).cast("string")
        ),
        "title": F.concat(kind, F.lit(" "), n.cast("string")),
        "summary": F.when(F.col("value") < 20, "").otherwise(F.concat(F.lit("worth "), F.floor("value").cast("string"))),
        "keywords": F.when(n % 2 == 0, F.col("props")),
        "notes": F.when(n % 11 == 0, F.concat(F.lit("note "), n.cast("string"))).otherwise(""),
        "raw_content": F.lit(""),
        "created_at": ts,
        "updated_at": ts,
        "scraped_at": F.when(n % 4 == 0, ts),
        "scrape_status": F.when(n % 4 == 0, "success").otherwise("pending"),
        "hidden": n % 17 == 0,
    }
    return events.select(*[values[c].alias(c) for c in BOOKMARK_COLUMNS], "event_id")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows made from the first half of the month, and the rows of the second half."""
    rows = event_rows(spark, sf_dir)
    early = F.col("created_at") < F.lit(_SPLIT).cast("timestamp")
    first = catalog.collapse_batch(rows.filter(early), ["event_id"])
    return catalog.new_rows(_empty(spark), first, "2024-01-16 00:00:00"), rows.filter(~early)


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _halves(spark, sf_dir)
    merged = catalog.upsert(stored, catalog.collapse_batch(incoming, ["event_id"]), BATCH_TIME)
    return with_shown_times(merged)


def upsert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``upsert_merge`` with blank texts and any status taking over."""
    stored, incoming = _halves(spark, sf_dir)
    batch = catalog.collapse_batch(incoming, ["event_id"], blank_is_null=False)
    return with_shown_times(catalog.upsert(stored, batch, BATCH_TIME, blank_is_null=False))


def upsert_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, incoming = _halves(spark, sf_dir)
    return catalog.upsert_stats(stored, incoming, ["event_id"])


def stale_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily gate for the last event time, for a missing and for a broken time."""
    last = table(spark, sf_dir, "events").agg(format_rfc3339(F.max(F.col("ts").cast("timestamp"))).alias("value"))
    state = last.select(F.lit(LAST_REFRESH_KEY).alias("key"), "value").union(last.select(F.lit("broken"), F.substring("value", 1, 9)))
    checks = [("fresh", LAST_REFRESH_KEY, "2024-01-31 02:00:00"), ("old", LAST_REFRESH_KEY, "2024-02-02 00:00:00")]
    checks += [("missing", "nothing", BATCH_TIME), ("broken", "broken", BATCH_TIME)]
    parts = [listing.is_stale(state, now, key).select(F.lit(name).alias("what"), "stale") for name, key, now in checks]
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    return result


# --- streams ----------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events merged into a store by a stream."""
    store = new_store(spark)
    rows = _event_rows(_event_stream(spark, sf_dir))
    query = stream.stream_upsert(rows, store, "events", ["event_id"], clock=lambda: BATCH_TIME)
    query.awaitTermination()
    return with_shown_times(store.read("bookmarks"))


def stream_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed pages synced by a stream."""
    store, landed = new_store(spark), scratch_path(spark, "landing")
    all_pages(spark, sf_dir).write.json(landed, compression="gzip")
    pages = landing.stream_page_rows(spark, landed)
    stream.stream_sync(pages, store, "pages", clock=lambda: BATCH_TIME).awaitTermination()
    return _slim(store.read("bookmarks"))


def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls of a stream with repeats dropped."""
    rows = stream.drop_repeats(_event_rows(_event_stream(spark, sf_dir)), "created_at", "40 days")
    out = scratch_path(spark, "first-seen")
    writer = rows.select("url").writeStream.format("parquet").option("path", out)
    writer = writer.option("checkpointLocation", scratch_path(spark, "stream"))
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("url string").parquet(out)


# --- feeds as a data source -------------------------------------------------------------------


def _served_pages(spark: SparkSession, sf_dir: str) -> str:
    """The format that serves all pages from a folder with one file per page."""
    path = scratch_path(spark, "served")
    all_pages(spark, sf_dir).write.partitionBy("feed", "page_no").text(path)
    return page_source.register(spark, page_source.FolderClient(path))


def feed_source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feed_union`` on pages that come out of the data source, each of which is asked for once."""
    pages = stage(spark.read.format(_served_pages(spark, sf_dir)).load(), "fetched")
    landed = feeds.landed_feeds(feeds.select_feeds(feeds.FEEDS), pages, BATCH_TIME)
    batch = catalog.collapse_batch(feeds.reachable(landed), feeds.BATCH_ORDER)
    return _slim(catalog.new_rows(_empty(spark), batch, BATCH_TIME))


def feed_source_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages synced by a stream whose offsets are page numbers."""
    store = new_store(spark)
    pages = spark.readStream.format(_served_pages(spark, sf_dir)).load()
    stream.stream_sync(pages, store, "served", clock=lambda: BATCH_TIME).awaitTermination()
    return _slim(store.read("bookmarks"))


# --- two fetches as a stream ------------------------------------------------------------------

FETCHES = ("2024-06-01 12:00:00", "2024-06-02 12:00:00")
#: The page that lands after all others.
LATE_PAGE = "feed = 'x' AND fetched_at < '2024-06-02' AND page_no = 0"


#: Documents whose pages two landed files hold, some tens of MB; more documents make more files, not larger ones.
DOCS_PER_FILE = 20_000


def fetch_listing(spark: SparkSession, sf_dir: str, no: int) -> DataFrame:
    """What the feeds list at each of two fetches, newest first: ``doc_id``, its time ``t`` and place ``pos``.

    The first fetch finds the first three fifths of the documents. At the second all are there, and
    every seventh of the former was saved ``again`` later. Places follow from the ids, so no window is needed.
    """
    docs = documents(spark, sf_dir)
    size = docs.agg(F.struct((F.max("doc_id") + 1).alias("n"), F.floor((F.max("doc_id") + 1) * 3 / 5).alias("first")).alias("size"))
    docs = docs.withColumn("size", size.scalar())
    n, first, doc = F.col("size.n"), F.col("size.first"), F.col("doc_id")
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    if no == 0:
        return docs.filter(doc < first).select("*", F.lit(False).alias("again"), (start + doc * 60).alias("t"), (first - 1 - doc).alias("pos"))
    again = (doc < first) & (doc % 7 == 3)
    repeats = F.floor((first - 4) / 7) + 1
    passed = F.when(doc < first, F.floor((doc - 3) / 7) + 1).otherwise(repeats)
    pos = F.when(again, repeats - passed).otherwise(n - 1 - doc + passed)
    return docs.select("*", again.alias("again"), (start + (doc + F.when(again, 2 * n).otherwise(0)) * 60).alias("t"), pos.cast("long").alias("pos"))


def fetched_pages(spark: SparkSession, sf_dir: str, no: int) -> DataFrame:
    """``(feed, page_no, body, fetched_at)`` of one fetch; every feed lands all its pages."""
    docs = fetch_listing(spark, sf_dir, no)
    # Whole documents are grouped, and pages made from a group: the feeds then have one shuffle between them.
    doc = F.struct("doc_id", "text", "lang", "source", "again", "t", "pos").alias("doc")
    groups = docs.select((F.col("pos") / GROUP).cast("int").alias("group"), doc).groupBy("group").agg(F.collect_list("doc").alias("docs"))
    again = lambda d: F.when(d["again"], " again").otherwise("")

    def repo(d: Column) -> Column:
        name = F.concat(d["source"], F.lit("/"), d["doc_id"].cast("string"), again(d))
        told = F.when(d["doc_id"] % 3 > 0, d["text"])
        one = F.struct(name.alias("full_name"), _doc_link(d["doc_id"]).alias("html_url"), told.alias("description"))
        return F.struct(format_rfc3339(F.timestamp_seconds(d["t"])).alias("starred_at"), one.alias("repo"))

    def link(d: Column) -> Column:
        return F.struct(
            d["doc_id"].alias("_id"), F.concat(F.lit("doc "), d["doc_id"].cast("string"), again(d)).alias("title"),
            _doc_link(d["doc_id"]).alias("link"), F.when(d["doc_id"] % 5 == 0, "").otherwise(d["text"]).alias("excerpt"),
            d["source"].alias("note"), format_rfc3339(F.timestamp_seconds(d["t"])).alias("created"), F.array(d["lang"], d["source"]).alias("tags"),
        )

    def post(d: Column) -> Column:
        when = F.date_format(F.timestamp_seconds(d["t"]), "EEE MMM dd HH:mm:ss Z yyyy")
        return F.struct(
            d["doc_id"].cast("string").alias("id"), F.concat(F.ltrim(again(d)), d["text"]).alias("text"), when.alias("createdAt"),
            F.struct(d["source"].alias("username")).alias("author"),
        )

    parts = []
    for feed, item, size in (("github", repo, 100), ("raindrop", link, 50), ("x", post, 100)):
        page = lambda d: (d["pos"] / size).cast("int")  # noqa: B023, E731
        placed = groups.select("docs", F.explode(F.array_distinct(F.transform("docs", page))).alias("page_no"))
        own = F.array_sort(F.transform(F.filter("docs", lambda d: page(d) == F.col("page_no")), lambda d: F.struct(d["pos"].alias("pos"), item(d).alias("item"))))
        pages = placed.select("page_no", F.transform(own, lambda e: e["item"]).alias("items"))
        if feed == "x":
            last = docs.agg((F.max("pos") / size).cast("int").alias("last"))
            cursor = F.when(F.col("page_no") < F.col("last"), F.concat(F.lit("c"), F.col("page_no").cast("string"))).otherwise("")
            body = F.to_json(F.struct(F.col("items").alias("tweets"), cursor.alias("nextCursor")))
            pages = pages.withColumn("last", last.scalar())
        else:  # a full last page does not end a fetch, an empty one after it does
            body = F.to_json("items")
            beyond = docs.agg((F.max("pos") / size + 1).cast("int").alias("page_no")).select(F.lit(feed).alias("feed"), "page_no", F.lit("[]").alias("body"))
            parts.append(beyond)
        parts.append(pages.select(F.lit(feed).alias("feed"), "page_no", body.alias("body")))
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("fetched_at", F.lit(FETCHES[no]).cast("timestamp"))


def landed_fetches(spark: SparkSession, sf_dir: str) -> landing.FetchedPages:
    """The pages of two fetches mixed over landed files, half of them a micro-batch; one old page lands after all others."""
    path = scratch_path(spark, "landing")
    both = fetched_pages(spark, sf_dir, 0).unionByName(fetched_pages(spark, sf_dir, 1))
    late = F.expr(LATE_PAGE)
    half = 2 * (1 + documents(spark, sf_dir).count() // DOCS_PER_FILE)
    both.filter(~late).repartition(2 * half, "page_no", "feed").write.json(path, compression="gzip")
    both.filter(late).write.mode("append").json(path, compression="gzip")
    return landing.FetchedPages(spark, path, files_per_batch=half)


def stream_sync_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fetches of all feeds, their pages mixed over several micro-batches, one old page after all others."""
    store, pages = new_store(spark), landed_fetches(spark, sf_dir)
    stream.stream_sync_fetches(pages, store, "fetches").awaitTermination()
    return _slim(store.read("bookmarks"))


def sync_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two fetches as two batch syncs."""
    store = new_store(spark)
    for no, when in enumerate(FETCHES):
        sync(store, fetched_pages(spark, sf_dir, no).drop("fetched_at"), when, f"fetch-{no}")
    return _slim(store.read("bookmarks"))


# --- SQL --------------------------------------------------------------------------------------

_DOC_TIME = "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id)"
_FEED_TIME = f"CASE WHEN doc_id % 13 = 0 THEN {NOW_SQL} ELSE {_DOC_TIME} END"
_EX = "'https://example.org/d/' || doc_id"
_X_URL = "'https://x.com/' || source || '/status/' || doc_id"

_FEED_ROWS = f"""github AS (
  SELECT {_EX} AS url, 'github' AS source, source || '/' || doc_id AS title,
         CASE WHEN doc_id % 3 > 0 THEN text ELSE '' END AS summary, '' AS keywords, '' AS notes,
         {_FEED_TIME} AS created_at, doc_id // 100 AS page_no, doc_id % 100 AS pos FROM documents),
x AS (
  SELECT {_X_URL} AS url, 'x' AS source, {sql_snippet('text', 100)} AS title, '' AS summary, '' AS keywords, '' AS notes,
         {_FEED_TIME} AS created_at, doc_id // 100 AS page_no, doc_id % 100 AS pos FROM documents),
raindrop AS (
  SELECT {_EX} AS url, 'raindrop' AS source, 'doc ' || doc_id AS title,
         CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS summary, lang || ',' || source AS keywords, source AS notes,
         {_FEED_TIME} AS created_at, doc_id // 50 AS page_no, doc_id % 50 AS pos FROM documents)"""

_PLACE = "page_no::INTEGER AS page_no, pos::INTEGER AS pos"

_UNION_SQL = f"""WITH {_FEED_ROWS},
merged AS (
  SELECT {sql_id('url')} AS id, g.source, url, r.title,
         coalesce(nullif(r.summary, ''), g.summary) AS summary, r.keywords, r.notes, g.created_at
  FROM github g JOIN raindrop r USING (url)
  UNION ALL SELECT {sql_id('url')}, source, url, title, summary, keywords, notes, created_at FROM x),
stored AS (
  SELECT id, source, url, title, summary, keywords, notes, '' AS raw_content, created_at, {NOW_SQL} AS updated_at,
         NULL::TIMESTAMP AS scraped_at, 'pending' AS scrape_status, false AS hidden FROM merged)
SELECT {_slim_sql()} FROM stored"""

_TWO_FETCHES_SQL = f"""WITH size AS (SELECT max(doc_id) + 1 AS n, (max(doc_id) + 1) * 3 // 5 AS first FROM documents),
saved AS (
  SELECT d.*, doc_id < first AND doc_id % 7 = 3 AS again, doc_id >= first OR doc_id % 7 = 3 AS in_second, {_DOC_TIME} AS created_at
  FROM documents d, size),
timed AS (
  SELECT *, CASE WHEN in_second THEN TIMESTAMP '{FETCHES[1]}' ELSE TIMESTAMP '{FETCHES[0]}' END AS updated_at,
         CASE WHEN again THEN ' again' ELSE '' END AS more, CASE WHEN again THEN 'again' || text ELSE text END AS post FROM saved),
rows AS (
  SELECT {_EX} AS url, 'github' AS source, 'doc ' || doc_id || more AS title, CASE WHEN doc_id % 15 = 0 THEN '' ELSE text END AS summary,
         lang || ',' || source AS keywords, source AS notes, created_at, updated_at FROM timed
  UNION ALL SELECT {_X_URL}, 'x', {sql_snippet('post', 100)}, '', '', '', created_at, updated_at FROM timed),
stored AS (
  SELECT {sql_id('url')} AS id, *, '' AS raw_content, NULL::TIMESTAMP AS scraped_at, 'pending' AS scrape_status, false AS hidden FROM rows)
SELECT {_slim_sql()} FROM stored"""

_STATE_SQL = f"""SELECT 'github_last_sync_ts' AS key, strftime({NOW_SQL}, '%Y-%m-%dT%H:%M:%SZ') AS value
UNION ALL SELECT 'raindrop_last_sync_ts', strftime({NOW_SQL}, '%Y-%m-%dT%H:%M:%SZ')
UNION ALL SELECT 'last_refresh_at', strftime({NOW_SQL}, '%Y-%m-%dT%H:%M:%SZ')
UNION ALL SELECT 'x_last_sync_ts', strftime(max({_DOC_TIME}), '%Y-%m-%dT%H:%M:%SZ') FROM documents WHERE doc_id % 13 > 0"""

_ITEMS = f"""items AS (
  SELECT user_id, event_id, ({_END_US} - epoch_us(ts)) // {_DAY_US} AS page_no, {_END_US} - epoch_us(ts) AS seq,
         CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN ts - INTERVAL 6 DAY ELSE ts END AS given,
         CASE WHEN user_id % 7 > 0 THEN TIMESTAMP '2024-01-08 00:00:00' + to_days((user_id % 15)::INTEGER) END AS mark
  FROM events),
timed AS (SELECT *, date_trunc('second', coalesce(given, {NOW_SQL})) AS eff, date_trunc('second', given) AS sec FROM items),
bounds AS (SELECT user_id, min(seq) FILTER (eff <= mark) AS first_old FROM timed GROUP BY user_id),
page_flags AS (SELECT user_id, page_no, bool_and(coalesce(sec <= mark, false)) AS all_old FROM timed GROUP BY ALL),
last_pages AS (SELECT user_id, min(page_no) FILTER (all_old) AS last_page FROM page_flags GROUP BY user_id)"""

_EVENT_ROWS = f"""rows AS (
  SELECT event_id, ['github', 'x', 'raindrop'][event_id % 3 + 1] AS source,
         'https://example.org/u/' || user_id || '/' || event_type || '/' || hour(ts) AS url,
         event_type || ' ' || event_id AS title,
         CASE WHEN value < 20 THEN '' ELSE 'worth ' || floor(value)::BIGINT END AS summary,
         CASE WHEN event_id % 2 = 0 THEN props END AS keywords,
         CASE WHEN event_id % 11 = 0 THEN 'note ' || event_id ELSE '' END AS notes,
         '' AS raw_content, ts AS created_at, CASE WHEN event_id % 4 = 0 THEN ts END AS scraped_at,
         CASE WHEN event_id % 4 = 0 THEN 'success' ELSE 'pending' END AS scrape_status, event_id % 17 = 0 AS hidden
  FROM events)"""

_TEXTS = ("title", "summary", "keywords", "notes", "raw_content")


def _folded_sql(name: str, where: str, blank_is_null: bool = True) -> str:
    """One row per url of the rows matching ``where``: first identity, last content."""
    cols = []
    for c in (*_TEXTS, "scraped_at", "scrape_status"):
        v = f"nullif({c}, '')" if blank_is_null and c in _TEXTS else c
        cols.append(f"arg_max({v}, event_id) FILTER ({v} IS NOT NULL) AS {c}")
    first = ", ".join(f"arg_min({c}, event_id) AS {c}" for c in ("source", "created_at", "hidden"))
    return f"{name} AS (SELECT url, {first}, {', '.join(cols)} FROM rows WHERE {where} GROUP BY url)"


def _inserted_sql(alias: str, now: str) -> str:
    """Column list of a folded row stored for the first time."""
    texts = {c: f"coalesce({alias}.{c}, '')" for c in _TEXTS}
    values = {"id": sql_id(f"{alias}.url"), "updated_at": now, **texts}
    return ", ".join(f"{values.get(c, f'{alias}.{c}')} AS {c}" for c in BOOKMARK_COLUMNS)


def _merged_sql(blank_is_null: bool) -> str:
    status = "coalesce(n.scrape_status, s.scrape_status)"
    if blank_is_null:
        status = f"CASE WHEN s.scrape_status = 'success' THEN 'success' ELSE {status} END"
    values = {c: f"coalesce(n.{c}, s.{c})" for c in (*_TEXTS, "scraped_at")}
    values |= {"scrape_status": status, "updated_at": f"CASE WHEN n.url IS NULL THEN s.updated_at ELSE {NOW_SQL} END"}
    kept = ", ".join(f"{values.get(c, f's.{c}')} AS {c}" for c in BOOKMARK_COLUMNS)
    columns = ", ".join(f"{sql_time(c)} AS {c}" if c.endswith("_at") else c for c in BOOKMARK_COLUMNS)
    return f"""WITH {_EVENT_ROWS},
{_folded_sql('f', f"created_at < TIMESTAMP '{_SPLIT}'")},
{_folded_sql('n', f"created_at >= TIMESTAMP '{_SPLIT}'", blank_is_null)},
s AS (SELECT {_inserted_sql('f', f"TIMESTAMP '{_SPLIT}'")} FROM f),
merged AS (
  SELECT {kept}, false AS is_new, n.url IS NOT NULL AS changed FROM s LEFT JOIN n USING (url)
  UNION ALL SELECT {_inserted_sql('n', NOW_SQL)}, true, true FROM n WHERE url NOT IN (SELECT url FROM s))
SELECT {columns}, is_new, changed FROM merged"""


_EVENT_STORE_SQL = f"""WITH {_EVENT_ROWS}, {_folded_sql('f', 'true')}, s AS (SELECT {_inserted_sql('f', NOW_SQL)} FROM f)
SELECT {", ".join(f"{sql_time(c)} AS {c}" if c.endswith("_at") else c for c in BOOKMARK_COLUMNS)} FROM s"""

QUERIES = {
    "feed_normalize_x": feed_normalize_x,
    "feed_normalize_raindrop": feed_normalize_raindrop,
    "feed_normalize_github": feed_normalize_github,
    "feed_union": feed_union,
    "sync_store": sync_store,
    "sync_store_state": sync_store_state,
    "sync_short_page": sync_short_page,
    "incremental_take_while": incremental_take_while,
    "incremental_filter_page": incremental_filter_page,
    "sync_mark": sync_mark,
    "upsert_merge": upsert_merge,
    "upsert_overwrite": upsert_overwrite,
    "upsert_stats": upsert_stats,
    "stale_gate": stale_gate,
    "stream_upsert": stream_upsert,
    "stream_sync": stream_sync,
    "stream_first_seen": stream_first_seen,
    "stream_sync_fetches": stream_sync_fetches,
    "sync_fetches": sync_fetches,
    "feed_source_scan": feed_source_scan,
    "feed_source_stream": feed_source_stream,
}

ORACLE = {
    "feed_normalize_x": f"""WITH {_FEED_ROWS}
SELECT url, source, title, {sql_time('created_at')} AS created_at, 'pending' AS scrape_status, {_PLACE} FROM x""",
    "feed_normalize_raindrop": f"""WITH {_FEED_ROWS}
SELECT url, source, title, md5(summary) AS summary, keywords, notes, {sql_time('created_at')} AS created_at, {_PLACE} FROM raindrop""",
    "feed_normalize_github": f"""WITH {_FEED_ROWS}
SELECT url, source, title, md5(summary) AS summary, {sql_time('created_at')} AS created_at, {_PLACE} FROM github""",
    "feed_union": _UNION_SQL,
    "sync_store": _UNION_SQL,
    "sync_store_state": _STATE_SQL,
    "sync_short_page": _UNION_SQL.replace("FROM documents", "FROM some_documents").replace(
        "WITH ", "WITH some_documents AS (SELECT * FROM documents WHERE doc_id % 7 > 0), ", 1
    ),
    "incremental_take_while": f"""WITH {_ITEMS}
SELECT user_id::VARCHAR AS feed, event_id FROM timed JOIN bounds USING (user_id) WHERE first_old IS NULL OR seq < first_old""",
    "incremental_filter_page": f"""WITH {_ITEMS}
SELECT user_id::VARCHAR AS feed, event_id FROM timed JOIN last_pages USING (user_id)
WHERE (last_page IS NULL OR page_no <= last_page) AND (mark IS NULL OR given IS NULL OR sec > mark)""",
    "sync_mark": f"""WITH {_ITEMS},
taken AS (SELECT user_id, max(eff) AS newest, any_value(mark) AS mark FROM timed JOIN bounds USING (user_id)
          WHERE first_old IS NULL OR seq <= first_old GROUP BY user_id),
paged AS (SELECT user_id, max(sec) FILTER (last_page IS NULL OR page_no <= last_page) AS newest, any_value(mark) AS mark
          FROM timed JOIN last_pages USING (user_id) GROUP BY user_id)
SELECT 'take_while' AS rule, user_id::VARCHAR AS feed, {sql_time('greatest(mark, newest)')} AS mark FROM taken
UNION ALL SELECT 'in_page', user_id::VARCHAR, {sql_time('greatest(mark, newest)')} FROM paged""",
    "upsert_merge": _merged_sql(True),
    "upsert_overwrite": _merged_sql(False),
    "upsert_stats": f"""WITH {_EVENT_ROWS},
incoming AS (SELECT * FROM rows WHERE created_at >= TIMESTAMP '{_SPLIT}'),
firsts AS (SELECT url, arg_min(source, event_id) AS source FROM incoming
           WHERE url NOT IN (SELECT url FROM rows WHERE created_at < TIMESTAMP '{_SPLIT}') GROUP BY url),
fresh AS (SELECT source, count(*) AS n FROM firsts GROUP BY source)
SELECT source, coalesce(any_value(n), 0) AS new_items, count(*) - coalesce(any_value(n), 0) AS skipped_items
FROM incoming LEFT JOIN fresh USING (source) GROUP BY source""",
    "stale_gate": """SELECT 'fresh' AS what, epoch_us(TIMESTAMP '2024-01-31 02:00:00') - epoch_us(date_trunc('second', max(ts))) >= 86400000000 AS stale FROM events
UNION ALL SELECT 'old', epoch_us(TIMESTAMP '2024-02-02 00:00:00') - epoch_us(date_trunc('second', max(ts))) >= 86400000000 FROM events
UNION ALL SELECT 'missing', true UNION ALL SELECT 'broken', true""",
    "stream_upsert": _EVENT_STORE_SQL,
    "stream_sync": _UNION_SQL,
    "stream_sync_fetches": _TWO_FETCHES_SQL,
    "sync_fetches": _TWO_FETCHES_SQL,
    "feed_source_scan": _UNION_SQL,
    "feed_source_stream": _UNION_SQL,
    "stream_first_seen": f"WITH {_EVENT_ROWS} SELECT DISTINCT url FROM rows",
}
