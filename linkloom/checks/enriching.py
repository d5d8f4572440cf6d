"""Registered enrichment queries and their SQL twins.

The queue holds every waiting document bookmark and a new manual bookmark for every page. The
crawl is the ``pages`` table, so documents without page text of their own are not found in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import LEAD_KEYWORDS, LEAD_MIN_CHARS
from ..functions.text import stable_id
from ..operators import catalog, listing
from ..operators.answers import AnswerBook
from ..plans import enrich
from ..schema import BOOKMARK_COLUMNS
from ..session import stage
from ..sources.tables import TableStore
from .browse import NOW_SQL
from .ingest import new_store
from .scalar import sql_cap, sql_url_only
from .views import (
    BATCH_TIME,
    BOOKMARKS_SQL,
    DOC_URL,
    bookmarks,
    doc_url,
    shown_time,
    sql_id,
    sql_time,
    sql_title,
    sql_token_list,
    sql_trim,
    table,
)


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", F.col("html").alias("content"), F.col("page_id").alias("seq"))


def catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document bookmarks and one manual bookmark per page."""
    rows = bookmarks(spark, sf_dir)
    return rows.unionByName(catalog.manual_rows(rows, table(spark, sf_dir, "pages"), BATCH_TIME))


def enrich_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = listing.pending_queue(catalog_rows(spark, sf_dir))
    rows = enrich.acquire(queue, crawl(spark, sf_dir), scrape_bytes=enrich.SHORT.scrape_bytes)
    return rows.select("id", "url", "fetched", F.octet_length("raw_content").alias("bytes"), F.md5("raw_content").alias("content"))


def _shown(done: DataFrame) -> DataFrame:
    return done.select(
        "id",
        "title",
        F.md5("summary").alias("summary"),
        "keywords",
        F.md5("raw_content").alias("content"),
        shown_time("scraped_at").alias("scraped_at"),
        shown_time("updated_at").alias("updated_at"),
        "scrape_status",
        "outcome",
        "embedded_text_hash",
    )


def enrich_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole queue through page text, title, summary, keywords and embedding."""
    queue = listing.pending_queue(catalog_rows(spark, sf_dir))
    return _shown(enrich.enrich_rows(queue, BATCH_TIME, crawl(spark, sf_dir), limits=enrich.SHORT))


def enrich_state_uncut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``enrich_state`` with whole page texts, prompts and embedded texts."""
    queue = listing.pending_queue(catalog_rows(spark, sf_dir))
    return _shown(enrich.enrich_rows(queue, BATCH_TIME, crawl(spark, sf_dir)))


def _stored(spark: SparkSession, sf_dir: str) -> TableStore:
    store = new_store(spark)
    store.commit("rows", {"bookmarks": catalog_rows(spark, sf_dir)})
    return store


def _stored_state(store: TableStore) -> DataFrame:
    """The processed rows with their embedding's hash and their attempts in the ledger."""
    log = store.read("enrich_log").groupBy("id").agg(F.max("attempt").alias("attempts"), F.max_by("outcome", "attempt").alias("outcome"))
    hashes = store.read("vectors").select("id", "embedded_text_hash")
    rows = store.read("bookmarks").join(log, "id").join(hashes, "id", "left")
    return _shown(rows).join(log.select("id", "attempts"), "id")


def enrich_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run in parts that stops after the first, is taken up, and is then repeated: each row is processed once."""
    store, crawled = _stored(spark, sf_dir), crawl(spark, sf_dir)
    parts = {"rows_per_commit": max(1, store.read("bookmarks").count() // 3), "snapshot": crawled}
    enrich.enrich(store, BATCH_TIME, "run", most_commits=1, **parts)
    enrich.enrich(store, BATCH_TIME, "run", **parts)
    enrich.enrich(store, BATCH_TIME, "run", **parts)
    return _stored_state(store)


def enrich_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts each model was asked for: in a first run, and in a second over the same rows and a few more.

    The second run finds a third of the rows new; texts that any earlier row had are not asked again.
    """
    rows = catalog_rows(spark, sf_dir)
    waiting = listing.pending_queue(rows).withColumn("late", F.length("url") % 3 == 0)
    crawled, counts, book = crawl(spark, sf_dir), [], AnswerBook(new_store(spark).empty("answers"))
    for no, part in enumerate((waiting.filter(~F.col("late")), waiting)):
        book = AnswerBook(stage(book.stored.unionByName(book.additions()), "book"))
        done = stage(enrich.enrich_rows(part, BATCH_TIME, crawled, book=book), "cached")
        kept = done.agg(F.count_if(F.col("embedding").isNotNull()), F.count_if(F.col("summary") != "")).first()
        counts += [(no, name, calls, kept[0], kept[1]) for name, calls in book.calls.items()]
    return spark.createDataFrame(counts, "run int, model string, calls bigint, embedded bigint, summarized bigint")


def enrich_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = listing.pending_queue(catalog_rows(spark, sf_dir))
    return enrich.tally(enrich.enrich_rows(queue, BATCH_TIME, crawl(spark, sf_dir)))


def backfill_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listing.needs_summary(bookmarks(spark, sf_dir), None)
    return _shown(enrich.backfill_rows(rows, BATCH_TIME, limits=enrich.SHORT))


def reprocess_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and labelled documents processed again, named by id or by url."""
    rows = catalog_rows(spark, sf_dir)
    pages = table(spark, sf_dir, "pages").select(stable_id(F.col("url")).alias("key"))
    keys = pages.union(table(spark, sf_dir, "labels").select(doc_url().alias("key")))
    found = listing.lookup(rows, keys).filter(F.col("id").isNotNull()).select(*BOOKMARK_COLUMNS)
    reset = stage(enrich.reset(found, BATCH_TIME), "reset")
    done = enrich.enrich_rows(reset, BATCH_TIME, crawl(spark, sf_dir), mode=enrich.REPROCESS, limits=enrich.SHORT)
    return _shown(done)


# --- SQL --------------------------------------------------------------------------------------

_CATALOG_SQL = f"""{BOOKMARKS_SQL},
catalog AS (
  SELECT * FROM bookmarks
  UNION ALL SELECT {sql_id('url')}, 'manual', url, url, '', '', '', '', {NOW_SQL}, {NOW_SQL}, NULL, 'pending', false
  FROM (SELECT DISTINCT url FROM pages) WHERE url NOT IN (SELECT url FROM bookmarks)),
crawl AS (SELECT url, arg_max(html, page_id) AS content FROM pages GROUP BY url)"""

def _acquired_sql(content: str) -> str:
    return f"""acquired AS (
  SELECT q.* REPLACE (CASE WHEN raw_content <> '' THEN raw_content ELSE coalesce({content}, '') END AS raw_content),
         raw_content <> '' OR content IS NOT NULL AS fetched
  FROM queue q LEFT JOIN crawl c USING (url))"""


_ACQUIRED_SQL = _acquired_sql(sql_cap("content", 50000))

_QUEUE_SQL = "queue AS (SELECT * FROM catalog WHERE scrape_status IN ('pending', 'failed'))"


def _model_sql(rows: str, content: str = sql_cap("raw_content", 10000)) -> str:
    """Summary and keywords the built-in model gives for the rows of ``rows(id, raw_content)``."""
    return f"""prompts AS (SELECT id, {content} AS content FROM {rows}),
words AS (SELECT id, unnest({sql_token_list('content')}) AS w FROM prompts),
counted AS (SELECT id, w, count(*) AS n FROM words WHERE length(w) >= {LEAD_MIN_CHARS} GROUP BY id, w),
best AS (SELECT id, string_agg(w, ', ' ORDER BY n DESC, w) AS new_keywords
         FROM (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, w) <= {LEAD_KEYWORDS}) GROUP BY id),
answers AS (SELECT p.id, {sql_trim("regexp_extract(content, '^[^.!?' || chr(10) || ']*')")} AS new_summary,
                   coalesce(new_keywords, '') AS new_keywords FROM prompts p LEFT JOIN best USING (id))"""


_EMBED_HASH = f"sha256({sql_cap('t', 30000)})"


def _final_sql(source: str, more: str = "", embedded: str = _EMBED_HASH) -> str:
    return f"""joined AS (SELECT *, title || ' ' || summary || ' ' || keywords AS t FROM {source})
SELECT id, title, md5(summary) AS summary, keywords, md5(raw_content) AS content, {sql_time('scraped_at')} AS scraped_at,
       {sql_time('updated_at')} AS updated_at, scrape_status, outcome,
       CASE WHEN outcome = 'success' THEN {embedded} END AS embedded_text_hash{more} FROM joined"""


_BARE = "(title = '' OR title = url)"
_QUEUE_STALE = f"(source = 'manual' AND {_BARE} OR source = 'x' AND {sql_url_only('title')})"
_REPROCESS_STALE = f"(source <> 'x' OR {sql_url_only('title')})"


def _enriched_sql(stale: str, uncut: bool = False) -> str:
    acquired = f"{_acquired_sql('content')}, {_model_sql('acquired', 'raw_content')}" if uncut else f"{_ACQUIRED_SQL}, {_model_sql('acquired')}"
    return f"""{acquired},
done AS (
  SELECT a.* REPLACE (
    CASE WHEN fetched AND {stale} THEN {sql_title('raw_content', 'title')} ELSE title END AS title,
    CASE WHEN fetched AND summary = '' THEN new_summary ELSE summary END AS summary,
    CASE WHEN fetched AND summary = '' AND keywords = '' THEN new_keywords ELSE keywords END AS keywords,
    CASE WHEN fetched THEN 'success' ELSE 'failed' END AS scrape_status,
    CASE WHEN fetched THEN {NOW_SQL} ELSE scraped_at END AS scraped_at,
    {NOW_SQL} AS updated_at),
    CASE WHEN fetched THEN 'success' ELSE 'fetch_failed' END AS outcome
  FROM acquired a JOIN answers USING (id))"""


def _uncut_sql(more: str = "") -> str:
    return f"WITH {_CATALOG_SQL}, {_QUEUE_SQL}, {_enriched_sql(_QUEUE_STALE, True)}, {_final_sql('done', more, 'sha256(t)')}"


_CACHED_SQL = f"""WITH {_CATALOG_SQL}, {_QUEUE_SQL}, {_enriched_sql(_QUEUE_STALE, True)},
given AS (
  SELECT id, length(d.url) % 3 = 0 AS late, d.summary <> '' AS summarized, d.outcome = 'success' AS good, a.fetched AND a.summary = '' AS asked,
         a.raw_content AS prompt, d.title || ' ' || d.summary || ' ' || d.keywords AS embedded
  FROM done d JOIN acquired a USING (id)),
runs AS (SELECT 0 AS run, * FROM given WHERE NOT late UNION ALL SELECT 1, * FROM given),
asked AS (
  SELECT run, 'lead' AS model, prompt AS text FROM runs WHERE asked
  UNION ALL SELECT run, 'hash', embedded FROM runs WHERE good),
firsts AS (SELECT min(run) AS run, model FROM asked GROUP BY model, text),
kept AS (SELECT run, count(*) FILTER (good) AS embedded, count(*) FILTER (summarized) AS summarized FROM runs GROUP BY run)
SELECT kept.run::INTEGER AS run, m.model, (SELECT count(*) FROM firsts f WHERE f.run = kept.run AND f.model = m.model) AS calls, embedded, summarized
FROM kept, (SELECT unnest(['lead', 'hash']) AS model) m"""


_CLEARED_SQL = f"""queue AS (
  SELECT c.* REPLACE ('pending' AS scrape_status, '' AS raw_content, '' AS summary, '' AS keywords, NULL::TIMESTAMP AS scraped_at)
  FROM catalog c WHERE url IN (SELECT url FROM pages UNION ALL SELECT {DOC_URL} FROM labels))"""

QUERIES = {
    "enrich_content": enrich_content,
    "enrich_state": enrich_state,
    "enrich_state_uncut": enrich_state_uncut,
    "enrich_resume": enrich_resume,
    "enrich_cached": enrich_cached,
    "enrich_tally": enrich_tally,
    "backfill_summary": backfill_summary,
    "reprocess_keys": reprocess_keys,
}

ORACLE = {
    "enrich_content": f"""WITH {_CATALOG_SQL}, {_QUEUE_SQL}, {_ACQUIRED_SQL}
SELECT id, url, fetched, strlen(raw_content)::INTEGER AS bytes, md5(raw_content) AS content FROM acquired""",
    "enrich_state": f"WITH {_CATALOG_SQL}, {_QUEUE_SQL}, {_enriched_sql(_QUEUE_STALE)}, {_final_sql('done')}",
    "enrich_state_uncut": _uncut_sql(),
    "enrich_resume": _uncut_sql(", 1 AS attempts"),
    "enrich_cached": _CACHED_SQL,
    "enrich_tally": f"""WITH {_CATALOG_SQL}, {_QUEUE_SQL}, {_ACQUIRED_SQL}
SELECT CASE WHEN fetched THEN 'success' ELSE 'fetch_failed' END AS outcome, count(*) AS n FROM acquired GROUP BY ALL""",
    "backfill_summary": f"""WITH {BOOKMARKS_SQL},
wanted AS (SELECT * FROM bookmarks WHERE raw_content <> '' AND summary = '' AND NOT hidden),
{_model_sql('wanted')},
done AS (
  SELECT b.* REPLACE (
    CASE WHEN new_summary <> '' THEN new_summary ELSE summary END AS summary,
    CASE WHEN new_summary <> '' THEN new_keywords ELSE keywords END AS keywords,
    CASE WHEN new_summary <> '' THEN {NOW_SQL} ELSE updated_at END AS updated_at),
    CASE WHEN new_summary <> '' THEN 'success' ELSE 'model_failed' END AS outcome
  FROM wanted b JOIN answers USING (id)),
{_final_sql('done')}""",
    "reprocess_keys": f"WITH {_CATALOG_SQL}, {_CLEARED_SQL}, {_enriched_sql(_REPROCESS_STALE)}, {_final_sql('done')}",
}
