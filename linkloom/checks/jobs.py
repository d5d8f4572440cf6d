"""Registered queries on whole jobs and on rules that only jobs use, with their SQL twins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models
from ..functions.text import stable_id
from ..operators import incremental, listing
from ..operators import vectors as vector_ops
from ..plans import enrich as enrich_plan
from ..plans import index as index_plan
from ..plans import search as search_plan
from ..plans.sync import sync
from ..sources import feeds
from .browse import _SORT_TIME, LISTING_LIMIT, _slim, _slim_sql
from .enriching import _model_sql
from .ingest import _EX, _FEED_TIME, _X_URL, all_pages, event_marks, github_pages, new_store, raindrop_pages, x_pages
from .scalar import sql_snippet
from .search import _POSTINGS_SQL, _RANKED, _shown, _vector_ctes, query_vector
from .views import BATCH_TIME, BOOKMARKS_SQL, VEC_URL, bookmarks, doc_url, documents, shown_time, sql_id, sql_time, table

LATER = "2024-06-02 12:00:00"


def feed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the feeds asked for: names in any case, a feed that is not enabled, an unknown one."""
    specs = feeds.select_feeds(["github", "x"], [" X", "raindrop", "none"])
    landed = feeds.landed_feeds(specs, all_pages(spark, sf_dir), BATCH_TIME)
    return feeds.reachable(landed).groupBy("source").agg(F.count("*").alias("items"), F.min("url").alias("first_url"))


def feed_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed of one's own, registered, synced and listed like the others."""
    spec = feeds.FeedSpec(
        name="shelf",
        item_schema="struct<link:string,label:string,day:string>",
        rule=feeds.TAKE_WHILE,
        item_time=lambda item: F.to_timestamp(item["day"]),
        fields=lambda item: {"url": item["link"], "title": item["label"]},
    )
    day = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + F.col("doc_id") * 86400), "yyyy-MM-dd")
    item = F.to_json(F.array(F.struct(doc_url().alias("link"), F.concat("lang", F.lit("/"), "source").alias("label"), day.alias("day"))))
    pages = documents(spark, sf_dir).select(F.lit("shelf").alias("feed"), F.col("doc_id").cast("int").alias("page_no"), item.alias("body"))
    known = dict(feeds.FEEDS)
    feeds.register_feed(spec)
    try:
        store = new_store(spark)
        sync(store, pages, BATCH_TIME, "shelf", enabled=["shelf"])
    finally:
        feeds.FEEDS.clear()
        feeds.FEEDS.update(known)
    return store.read("bookmarks").select("url", "source", "title", shown_time("created_at").alias("created_at"))


def sync_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreadable pages set aside, and what was stored of each feed: the pages before, or nothing."""
    store = new_store(spark)
    pages = github_pages(spark, sf_dir).union(x_pages(spark, sf_dir)).union(raindrop_pages(spark, sf_dir))
    broken = F.col("page_no") % 10 == 3
    body = F.when(broken, F.left("body", (F.length("body") / 2).cast("int"))).otherwise(F.col("body"))
    result = sync(store, pages.withColumn("body", body), BATCH_TIME, "damaged")
    aside = result.quarantine.groupBy("feed").agg(F.count("*").alias("pages"), F.min("page_no").alias("first_page"))
    stored = store.read("bookmarks").groupBy(F.col("source").alias("feed")).agg(F.count("*").alias("stored"))
    return aside.join(stored, "feed", "left").select("feed", "pages", "first_page", F.coalesce("stored", F.lit(0)).alias("stored"))


def sync_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forced sync after the feeds lost every third item: what they lost is gone, the raindrop feed did not land."""
    store = new_store(spark)
    sync(store, all_pages(spark, sf_dir), BATCH_TIME, "first")
    left = x_pages(spark, sf_dir, "doc_id % 3 > 0").union(github_pages(spark, sf_dir, "doc_id % 3 > 0"))
    sync(store, left, LATER, "second", force=True)
    return _slim(store.read("bookmarks"))


def sync_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forced sync that also resets what it meets again; new rows keep what the feed gave."""
    store = new_store(spark)
    sync(store, raindrop_pages(spark, sf_dir, "doc_id % 2 = 0"), BATCH_TIME, "first")
    sync(store, raindrop_pages(spark, sf_dir), LATER, "second", force=True, reprocess=True)
    return _slim(store.read("bookmarks"))


def sync_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrichment runs after a sync that brought something new, and not after one that did not."""
    store = new_store(spark)
    crawl = documents(spark, sf_dir).select(doc_url().alias("url"), F.col("text").alias("content"), F.col("doc_id").alias("seq"))
    given = {"snapshot": crawl}
    runs = [sync(store, github_pages(spark, sf_dir), when, when, enrichment=given, force=True) for when in (BATCH_TIME, LATER)]
    rows = [(i, r.new_items, r.tally is not None) for i, r in enumerate(runs)]
    done = store.read("bookmarks").filter("scrape_status = 'success'").agg(F.count("*").alias("enriched"))
    return spark.createDataFrame(rows, "run int, new_items bigint, ran boolean").withColumn("enriched", done.scalar())


def forced_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks as a forced fetch sees them and as it leaves them, with the newest event of each user."""
    saved = event_marks(spark, sf_dir)
    newest = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("feed")).agg(F.min(F.col("ts").cast("timestamp")).alias("newest"))
    kept = incremental.advance_marks(saved, newest)
    moved = incremental.advance_marks(saved, newest, never_back=False)
    return kept.select("feed", shown_time("mark").alias("kept")).join(moved.select("feed", shown_time("mark").alias("moved")), "feed")


def state_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved value and a missing one."""
    state = documents(spark, sf_dir).select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), F.md5("text").alias("value"))
    parts = [listing.read_state(state, key).select(F.lit(key).alias("key"), "value") for key in ("k7", "nothing")]
    return parts[0].union(parts[1])


def index_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of an older version is built again, a current one is left alone."""
    store = new_store(spark)
    old = spark.createDataFrame([(index_plan.INDEX_VERSION_KEY, "0:title")], "key string, value string")
    store.commit("rows", {"bookmarks": bookmarks(spark, sf_dir), "sync_state": old})
    steps = []
    for name in ("old", "current"):
        was, before = index_plan.is_current(store), store.snapshot().version
        index_plan.ensure_index(store, f"index-{name}")
        steps.append((name, was, index_plan.is_current(store), store.snapshot().version - before))
    terms = store.read("postings").agg(F.count_distinct("term").alias("terms"))
    return spark.createDataFrame(steps, "step string, before boolean, after boolean, commits int").withColumn("terms", terms.scalar())


def search_blank_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty query lists the newest, one without tokens finds nothing."""
    rows = bookmarks(spark, sf_dir)
    found = search_plan.search(rows, "", limit=LISTING_LIMIT).select(F.lit("empty").alias("query"), "id")
    for name, query in (("blank", "  "), ("points", " . -- !")):
        found = found.union(search_plan.search(rows, query, limit=LISTING_LIMIT).select(F.lit(name), "id"))
    return found


def vector_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector search over a table in which every ninth vector is empty and every tenth missing."""
    blank = F.when(F.col("vec_id") % 9 == 1, F.array().cast("array<float>")).when(F.col("vec_id") % 10 != 1, F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select(stable_id(doc_url("vec_id")).alias("id"), blank.alias("embedding"))
    return _shown(vector_ops.vector_topk(rows, query_vector(spark, sf_dir)))


def _shuffled(prompts: pd.Series) -> pd.Series:
    """Answers in reversed order, each under its own number; every fifth text is not answered."""
    return pd.Series({i: p.upper() for i, p in reversed(list(prompts.items())) if len(p) % 5})


def model_answers_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", F.concat("source", F.lit(" "), "lang", F.lit(" "), F.col("doc_id").cast("string")).alias("asked"))
    return docs.select("doc_id", models.apply_model(_shuffled, F.col("asked"), "string").alias("answer"))


def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in models by name, models of one's own, and no embedder."""
    rows = bookmarks(spark, sf_dir).filter("raw_content <> '' AND summary = ''")
    given = {"named": ("lead", "hash"), "own": (_own_summary, None)}
    parts = []
    for name, (summary, embedder) in given.items():
        done = enrich_plan.backfill_rows(rows, BATCH_TIME, summary, embedder)
        counted = done.agg(F.count("*").alias("rows"), F.count_if(F.col("keywords") == "own").alias("own"), F.count("embedding").alias("embedded"))
        parts.append(counted.select(F.lit(name).alias("models"), "*"))
    return parts[0].union(parts[1])


def _own_summary(prompts: pd.Series) -> pd.Series:
    return prompts.map(lambda p: "SUMMARY: s\nKEYWORDS: own")


# --- SQL --------------------------------------------------------------------------------------

_LATER = f"TIMESTAMP '{LATER}'"


def _stored_sql(rows: str) -> str:
    """Stored rows of ``url, source, title, summary, keywords, notes, created_at``."""
    return f"""WITH rows AS ({rows}),
stored AS (
  SELECT {sql_id('url')} AS id, *, '' AS raw_content, {_LATER} AS updated_at, NULL::TIMESTAMP AS scraped_at,
         'pending' AS scrape_status, false AS hidden FROM rows)
SELECT {_slim_sql()} FROM stored"""


QUERIES = {
    "feed_selection": feed_selection,
    "feed_registered": feed_registered,
    "sync_quarantine": sync_quarantine,
    "sync_force": sync_force,
    "sync_reprocess": sync_reprocess,
    "sync_gate": sync_gate,
    "forced_marks": forced_marks,
    "state_read": state_read,
    "index_version": index_version,
    "search_blank_queries": search_blank_queries,
    "vector_blanks": vector_blanks,
    "model_answers_aligned": model_answers_aligned,
    "model_choice": model_choice,
}

ORACLE = {
    "feed_selection": f"SELECT 'x' AS source, count(*) AS items, min({_X_URL}) AS first_url FROM documents",
    "feed_registered": f"""SELECT {_EX} AS url, 'shelf' AS source, lang || '/' || source AS title,
  {sql_time("TIMESTAMP '2024-01-01 00:00:00' + to_days(doc_id::INTEGER)")} AS created_at FROM documents""",
    "sync_quarantine": """WITH feeds(feed, size) AS (VALUES ('github', 100), ('x', 100), ('raindrop', 50)),
ends AS (SELECT feed, (SELECT max(doc_id) FROM documents) // size AS last FROM feeds)
SELECT feed, ((last - 3) // 10 + 1)::BIGINT AS pages, 3 AS first_page, (CASE feed WHEN 'github' THEN 300 ELSE 0 END)::BIGINT AS stored
FROM ends WHERE last >= 3""",
    "sync_force": _stored_sql(
        f"""SELECT {_EX} AS url, 'github' AS source, source || '/' || doc_id AS title, text AS summary, lang || ',' || source AS keywords,
  source AS notes, {_FEED_TIME} AS created_at FROM documents WHERE doc_id % 3 > 0
UNION ALL SELECT {_X_URL}, 'x', {sql_snippet('text', 100)}, '', '', '', {_FEED_TIME} FROM documents WHERE doc_id % 3 > 0"""
    ),
    "sync_reprocess": _stored_sql(
        f"""SELECT {_EX} AS url, 'raindrop' AS source, 'doc ' || doc_id AS title,
  CASE WHEN doc_id % 2 = 0 OR doc_id % 5 = 0 THEN '' ELSE text END AS summary,
  CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang || ',' || source END AS keywords, source AS notes,
  CASE WHEN doc_id % 13 = 0 AND doc_id % 2 = 1 THEN {_LATER} ELSE {_FEED_TIME} END AS created_at FROM documents"""
    ),
    "sync_gate": """SELECT 0 AS run, count(*) AS new_items, true AS ran, count(*) AS enriched FROM documents
UNION ALL SELECT 1, 0, false, count(*) FROM documents""",
    "forced_marks": f"""WITH users AS (
  SELECT user_id, min(ts) AS newest, CASE WHEN user_id % 7 > 0 THEN TIMESTAMP '2024-01-08 00:00:00' + to_days((user_id % 15)::INTEGER) END AS mark
  FROM events GROUP BY user_id)
SELECT user_id::VARCHAR AS feed, {sql_time('greatest(mark, newest)')} AS kept, {sql_time('newest')} AS moved FROM users""",
    "state_read": "SELECT 'k7' AS key, md5(text) AS value FROM documents WHERE doc_id = 7 UNION ALL SELECT 'nothing', ''",
    "index_version": f"""WITH {BOOKMARKS_SQL}, {_POSTINGS_SQL}, counted AS (SELECT count(DISTINCT term) AS terms FROM postings)
SELECT 'old' AS step, false AS before, true AS after, 1 AS commits, terms FROM counted
UNION ALL SELECT 'current', true, true, 0, terms FROM counted""",
    "search_blank_queries": f"""WITH {BOOKMARKS_SQL}
SELECT 'empty' AS query, id FROM (SELECT id FROM bookmarks WHERE NOT hidden ORDER BY {_SORT_TIME} DESC, id LIMIT {LISTING_LIMIT})""",
    "vector_blanks": f"""WITH vectors AS (SELECT {sql_id(VEC_URL)} AS id, embedding FROM embeddings WHERE vec_id % 9 <> 1 AND vec_id % 10 <> 1),
{_vector_ctes()} {_RANKED} vector_hits""",
    "model_answers_aligned": """SELECT doc_id, CASE WHEN length(asked) % 5 > 0 THEN upper(asked) END AS answer
FROM (SELECT doc_id, source || ' ' || lang || ' ' || doc_id AS asked FROM documents)""",
    "model_choice": f"""WITH {BOOKMARKS_SQL}, wanted AS (SELECT * FROM bookmarks WHERE raw_content <> '' AND summary = ''),
{_model_sql('wanted', 'raw_content')}
SELECT 'named' AS models, count(*) AS rows, 0::BIGINT AS own, count(*) FILTER (new_summary <> '') AS embedded FROM answers
UNION ALL SELECT 'own', count(*), count(*), 0 FROM wanted""",
}
