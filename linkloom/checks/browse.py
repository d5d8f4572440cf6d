"""Registered listing, queue, lookup and mutation queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..operators import catalog, listing
from ..schema import BOOKMARK_COLUMNS
from .views import (
    BATCH_TIME,
    BOOKMARKS_SQL,
    DOC_URL,
    VECTORS_SQL,
    bookmarks,
    documents,
    doc_url,
    shown_time,
    sql_id,
    sql_time,
    table,
    vectors,
    with_shown_times,
)

LISTING_LIMIT = 1000
NOW_SQL = f"TIMESTAMP '{BATCH_TIME}'"
_LISTING_SKIP = ("raw_content", "scraped_at")
_SORT_TIME = "CASE WHEN source IN ('raindrop', 'github', 'x') THEN created_at ELSE updated_at END"
_LOOSE = ("title", "summary", "raw_content")


def _slim(rows: DataFrame) -> DataFrame:
    """Long texts as digests; every row and every text still takes part."""
    return with_shown_times(rows).select(*[F.md5(c).alias(c) if c in _LOOSE else c for c in rows.columns])


def _slim_sql(skip: tuple[str, ...] = ()) -> str:
    columns = [c for c in BOOKMARK_COLUMNS if c not in skip]
    return ", ".join(
        f"{sql_time(c)} AS {c}" if c.endswith("_at") else f"md5({c}) AS {c}" if c in _LOOSE else c for c in columns
    )


def list_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slim(listing.list_recent(bookmarks(spark, sf_dir), LISTING_LIMIT))


def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slim(listing.list_recent(bookmarks(spark, sf_dir), LISTING_LIMIT, [" GitHub", "manual"]))


def list_toggled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.list_recent(bookmarks(spark, sf_dir), LISTING_LIMIT)
    return _slim(listing.post_filter(rows, {"x": True, "raindrop": False, "github": True, "manual": False}))


def pending_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slim(listing.pending_queue(bookmarks(spark, sf_dir)))


def pending_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue cut to one serial batch, oldest first."""
    return listing.pending_queue(bookmarks(spark, sf_dir), 100).select("id", "url", "scrape_status")


def needs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slim(listing.needs_summary(bookmarks(spark, sf_dir), None))


def needs_summary_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.needs_summary(bookmarks(spark, sf_dir), 10).select("id", "url", shown_time("updated_at").alias("updated_at"))


def count_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.count_visible(bookmarks(spark, sf_dir))


def point_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One read by id and one by url."""
    rows = bookmarks(spark, sf_dir)
    key = _FIRST_ID
    by_id = listing.get_by_id(rows, key).withColumn("how", F.lit("id"))
    by_url = listing.get_by_url(rows, "https://example.org/d/7").withColumn("how", F.lit("url"))
    return by_id.unionByName(by_url).select("how", "id", "url", "source", "title")


# Fixed value: the id of https://example.org/d/5.
_FIRST_ID = "ed9d06b7c87d5e4c"


def lookup_id_or_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys from labels: ids where the quality is good, urls otherwise, and page urls as strangers."""
    labels = table(spark, sf_dir, "labels")
    keys = labels.select(F.when(F.col("quality") == 1, stable_id(doc_url())).otherwise(doc_url()).alias("key"))
    strangers = table(spark, sf_dir, "pages").select(F.col("url").alias("key"))
    return listing.lookup(bookmarks(spark, sf_dir), keys.union(strangers)).select("key", "id", "url", "source")


def labelled_ids(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter(flag).select(stable_id(doc_url()).alias("id"))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GitHub rows whose url is no longer among the labelled ones."""
    current = table(spark, sf_dir, "labels").select(doc_url().alias("url"))
    return catalog.orphans(bookmarks(spark, sf_dir), current, "github")


def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids left in each table once the orphans are gone."""
    rows, gone = bookmarks(spark, sf_dir), orphans(spark, sf_dir)
    left = catalog.delete_ids(rows, gone).select(F.lit("bookmarks").alias("store"), "id")
    return left.union(catalog.delete_ids(vectors(spark, sf_dir), gone).select(F.lit("vectors"), "id"))


def mark_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slim(catalog.mark_for_reprocess(bookmarks(spark, sf_dir), labelled_ids(spark, sf_dir, "quality = 0")))


def reset_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = labelled_ids(spark, sf_dir, "quality = 0")
    return _slim(catalog.reset_for_reprocess(bookmarks(spark, sf_dir), ids, BATCH_TIME))


def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled bookmark gets a title and a summary that are too long, and new notes."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    edits = table(spark, sf_dir, "labels").join(docs, "doc_id").select(
        stable_id(doc_url()).alias("id"),
        F.concat(F.lit("edited "), "text").alias("title"),
        F.col("text").alias("summary"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("notes"),
    )
    return _slim(catalog.apply_edits(bookmarks(spark, sf_dir), edits, BATCH_TIME, catalog.EDIT_LIMITS))


def manual_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All page urls and all labelled bookmark urls: the former are added, the latter rejected."""
    rows = bookmarks(spark, sf_dir)
    urls = table(spark, sf_dir, "pages").select("url").union(table(spark, sf_dir, "labels").select(doc_url()))
    added = with_shown_times(catalog.manual_rows(rows, urls, BATCH_TIME)).select(
        "url", "id", "source", "title", "created_at", "scrape_status", F.lit("added").alias("outcome")
    )
    known = catalog.already_stored(rows, urls).select("url", F.lit("rejected").alias("outcome"))
    return added.unionByName(known, allowMissingColumns=True)


def put_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled vectors are replaced by a one-element vector holding their quality."""
    new = table(spark, sf_dir, "labels").select(
        stable_id(doc_url()).alias("id"), F.array(F.col("quality").cast("float")).alias("embedding")
    )
    rows = catalog.put_vectors(vectors(spark, sf_dir), new)
    return rows.select("id", F.size("embedding").alias("width"), F.element_at("embedding", 1).cast("double").alias("head"))


def _flagged_sql(flag: str, values: dict[str, str]) -> str:
    replaced = ", ".join(f"CASE WHEN l.id IS NOT NULL THEN {v} ELSE {c} END AS {c}" for c, v in values.items())
    return f"""WITH {BOOKMARKS_SQL},
l AS (SELECT {sql_id(DOC_URL)} AS id FROM labels WHERE {flag}),
changed AS (SELECT b.* REPLACE ({replaced}) FROM bookmarks b LEFT JOIN l USING (id))
SELECT {_slim_sql()} FROM changed"""


_CLEARED = {"scrape_status": "'pending'", "raw_content": "''", "summary": "''", "keywords": "''"}
_ORPHANS_SQL = f"""gone AS (
  SELECT id, source, url, title FROM bookmarks
  WHERE source = 'github' AND url NOT IN (SELECT {DOC_URL} FROM labels))"""

QUERIES = {
    "list_recent": list_recent,
    "list_sources": list_sources,
    "list_toggled": list_toggled,
    "pending_queue": pending_queue,
    "pending_batch": pending_batch,
    "needs_summary": needs_summary,
    "needs_summary_latest": needs_summary_latest,
    "count_visible": count_visible,
    "point_reads": point_reads,
    "lookup_id_or_url": lookup_id_or_url,
    "orphans": orphans,
    "delete_cascade": delete_cascade,
    "mark_reprocess": mark_reprocess,
    "reset_reprocess": reset_reprocess,
    "apply_edits": apply_edits,
    "manual_add": manual_add,
    "put_vectors": put_vectors,
}

_LISTED = f"SELECT * FROM bookmarks WHERE NOT hidden {{}} ORDER BY {_SORT_TIME} DESC, id LIMIT {LISTING_LIMIT}"

ORACLE = {
    "list_recent": f"WITH {BOOKMARKS_SQL} SELECT {_slim_sql(_LISTING_SKIP)} FROM ({_LISTED.format('')})",
    "list_sources": f"""WITH {BOOKMARKS_SQL}
SELECT {_slim_sql(_LISTING_SKIP)} FROM ({_LISTED.format("AND source IN ('github', 'manual')")})""",
    "list_toggled": f"""WITH {BOOKMARKS_SQL}
SELECT {_slim_sql(_LISTING_SKIP)} FROM ({_LISTED.format('')}) WHERE source IN ('x', 'github')""",
    "pending_queue": f"""WITH {BOOKMARKS_SQL}
SELECT {_slim_sql()} FROM bookmarks WHERE scrape_status IN ('pending', 'failed')""",
    "pending_batch": f"""WITH {BOOKMARKS_SQL} SELECT id, url, scrape_status FROM bookmarks
WHERE scrape_status IN ('pending', 'failed') ORDER BY created_at, id LIMIT 100""",
    "needs_summary": f"""WITH {BOOKMARKS_SQL}
SELECT {_slim_sql()} FROM bookmarks WHERE raw_content <> '' AND summary = '' AND NOT hidden""",
    "needs_summary_latest": f"""WITH {BOOKMARKS_SQL}
SELECT id, url, {sql_time('updated_at')} AS updated_at FROM (
  SELECT * FROM bookmarks WHERE raw_content <> '' AND summary = '' AND NOT hidden ORDER BY updated_at DESC, id LIMIT 10)""",
    "count_visible": f"WITH {BOOKMARKS_SQL} SELECT count(*) AS n FROM bookmarks WHERE NOT hidden",
    "point_reads": f"""WITH {BOOKMARKS_SQL}
SELECT 'id' AS how, id, url, source, title FROM bookmarks WHERE url = 'https://example.org/d/5'
UNION ALL SELECT 'url', id, url, source, title FROM bookmarks WHERE url = 'https://example.org/d/7'""",
    "lookup_id_or_url": f"""WITH {BOOKMARKS_SQL},
keys AS (SELECT DISTINCT CASE WHEN quality = 1 THEN {sql_id(DOC_URL)} ELSE {DOC_URL} END AS key FROM labels
         UNION SELECT url FROM pages)
SELECT key, id, url, source FROM keys LEFT JOIN bookmarks ON id = key OR url = key""",
    "orphans": f"WITH {BOOKMARKS_SQL}, {_ORPHANS_SQL} SELECT id, source, url, title FROM gone",
    "delete_cascade": f"""WITH {BOOKMARKS_SQL}, {VECTORS_SQL}, {_ORPHANS_SQL}
SELECT 'bookmarks' AS store, id FROM bookmarks WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'vectors', id FROM vectors WHERE id NOT IN (SELECT id FROM gone)""",
    "mark_reprocess": _flagged_sql("quality = 0", _CLEARED),
    "reset_reprocess": _flagged_sql("quality = 0", _CLEARED | {"scraped_at": "NULL", "updated_at": NOW_SQL}),
    "apply_edits": f"""WITH {BOOKMARKS_SQL},
l AS (SELECT {sql_id(DOC_URL)} AS id, left('edited ' || text, 256) AS new_title, left(text, 500) AS new_summary,
             left('quality ' || quality, 500) AS new_notes FROM labels JOIN documents USING (doc_id)),
changed AS (SELECT b.* REPLACE (
    CASE WHEN l.id IS NOT NULL THEN new_title ELSE title END AS title,
    CASE WHEN l.id IS NOT NULL THEN new_summary ELSE summary END AS summary,
    CASE WHEN l.id IS NOT NULL THEN new_notes ELSE notes END AS notes,
    CASE WHEN l.id IS NOT NULL THEN {NOW_SQL} ELSE updated_at END AS updated_at)
  FROM bookmarks b LEFT JOIN l USING (id))
SELECT {_slim_sql()} FROM changed""",
    "manual_add": f"""WITH {BOOKMARKS_SQL},
urls AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT {DOC_URL} FROM labels))
SELECT url, {sql_id('url')} AS id, 'manual' AS source, url AS title, {sql_time(NOW_SQL)} AS created_at,
       'pending' AS scrape_status, 'added' AS outcome
FROM urls WHERE url NOT IN (SELECT url FROM bookmarks)
UNION ALL SELECT url, NULL, NULL, NULL, NULL, NULL, 'rejected' FROM urls WHERE url IN (SELECT url FROM bookmarks)""",
    "put_vectors": f"""WITH {VECTORS_SQL},
l AS (SELECT {sql_id(DOC_URL)} AS id, [quality::FLOAT] AS embedding FROM labels)
SELECT id, len(embedding)::INTEGER AS width, embedding[1]::DOUBLE AS head
FROM (SELECT * FROM vectors WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT * FROM l)""",
}
