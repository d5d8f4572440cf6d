"""Table schemas and the fixed values shared by every job."""

from __future__ import annotations

from pyspark.sql import types as T

SOURCES = ("github", "x", "raindrop", "manual")

# Feeds whose rows are listed by the time given by the feed itself.
FEED_SOURCES = ("raindrop", "github", "x")

PENDING, SUCCESS, FAILED = "pending", "success", "failed"

# Text columns covered by the full-text index, in index order.
INDEXED_FIELDS = ("title", "summary", "keywords", "notes", "url")

BOOKMARK_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("keywords", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("raw_content", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("scraped_at", T.TimestampType()),
        T.StructField("scrape_status", T.StringType()),
        T.StructField("hidden", T.BooleanType()),
    ]
)
BOOKMARK_COLUMNS = tuple(BOOKMARK_SCHEMA.fieldNames())

# A listing leaves out the page text and the scrape time.
LISTING_COLUMNS = tuple(c for c in BOOKMARK_COLUMNS if c not in ("raw_content", "scraped_at"))

VECTOR_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("embedded_text_hash", T.StringType()),
    ]
)

SYNC_STATE_SCHEMA = T.StructType(
    [T.StructField("key", T.StringType(), False), T.StructField("value", T.StringType(), False)]
)

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("feed", T.StringType(), False),
        T.StructField("page_no", T.IntegerType(), False),
        T.StructField("body", T.StringType()),
    ]
)

# Pages that say which fetch they belong to: ``fetched_at`` is when their fetch started.
FETCHED_PAGE_SCHEMA = T.StructType([*PAGE_SCHEMA.fields, T.StructField("fetched_at", T.TimestampType(), False)])

LAST_REFRESH_KEY = "last_refresh_at"


def mark_key(feed: str) -> str:
    """Sync-state key holding the high-water mark of one feed."""
    return f"{feed}_last_sync_ts"
