"""The bookmark catalog the registered queries run on, in Spark and in SQL.

The given tables hold no bookmarks, so both sides build them from ``documents`` by the same
expressions: every document is one bookmark, its whole text is the summary and the page text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stable_id, title_from_content
from ..schema import BOOKMARK_COLUMNS
from ..session import spread

BATCH_TIME = "2024-06-01 12:00:00"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def doc_url(doc_id: str = "doc_id") -> Column:
    return F.concat(F.lit("https://example.org/d/"), F.col(doc_id).cast("string"))


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    doc = F.col("doc_id")
    names = ("x", "raindrop", "github", "manual")
    start = F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    values = {
        "id": stable_id(doc_url()),
        "source": F.element_at(F.array(*[F.lit(n) for n in names]), (doc % 4 + 1).cast("int")),
        "url": doc_url(),
        "title": title_from_content(F.col("text"), doc_url()),
        "summary": F.when(doc % 5 == 0, "").otherwise(F.col("text")),
        "keywords": F.col("lang"),
        "notes": F.col("source"),
        "raw_content": F.when(doc % 7 == 0, "").otherwise(F.col("text")),
        "created_at": F.timestamp_seconds(start + doc * 60),
        "updated_at": F.timestamp_seconds(start + doc * 60 + (doc % 97) * 3600),
        "scrape_status": F.when(doc % 3 == 0, "success").when(doc % 3 == 1, "pending").otherwise("failed"),
        "hidden": doc % 11 == 0,
    }
    values["scraped_at"] = F.when(doc % 3 == 0, values["updated_at"])
    return docs.select(*[values[c].alias(c) for c in BOOKMARK_COLUMNS])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(stable_id(doc_url("vec_id")).alias("id"), "embedding")


def shown_time(c: str | Column) -> Column:
    return F.date_format(c, TIME_FORMAT)


def with_shown_times(rows: DataFrame) -> DataFrame:
    """Times as text, which every engine prints alike."""
    return rows.select(*[shown_time(c).alias(c) if c.endswith("_at") else F.col(c) for c in rows.columns])


# --- the same in SQL --------------------------------------------------------------------------


def sql_trim(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\x0B\x85\p{{Z}}]+|[\s\x0B\x85\p{{Z}}]+$', '', 'g')"


def sql_title(content: str, fallback: str) -> str:
    line = f"split_part(left(coalesce({content}, ''), 100), chr(10), 1)"
    trimmed = sql_trim(line)
    rest = sql_trim(f"substr({trimmed}, 7)")
    marked = f"lower(left({trimmed}, 6)) = 'title:'"
    return (
        f"CASE WHEN {line} = '' THEN {fallback} WHEN {marked} AND {rest} <> '' THEN {rest} "
        f"WHEN {marked} AND {fallback} <> '' THEN {fallback} ELSE {line} END"
    )


def sql_time(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def sql_id(url: str) -> str:
    return f"left(sha256({url}), 16)"


DOC_URL = "'https://example.org/d/' || doc_id"
VEC_URL = "'https://example.org/d/' || vec_id"

BOOKMARKS_SQL = f"""
docs AS (SELECT *, {DOC_URL} AS url FROM documents),
bookmarks AS (
  SELECT {sql_id('url')} AS id,
         CASE doc_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'raindrop' WHEN 2 THEN 'github' ELSE 'manual' END AS source,
         url,
         {sql_title('text', 'url')} AS title,
         CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS summary,
         lang AS keywords,
         source AS notes,
         CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS raw_content,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) + to_hours(doc_id % 97) AS updated_at,
         CASE WHEN doc_id % 3 = 0
              THEN TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) + to_hours(doc_id % 97) END AS scraped_at,
         CASE doc_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'pending' ELSE 'failed' END AS scrape_status,
         doc_id % 11 = 0 AS hidden
  FROM docs)"""

VECTORS_SQL = f"vectors AS (SELECT {sql_id(VEC_URL)} AS id, embedding FROM embeddings)"


def sql_tokens(c: str) -> str:
    """Token text of a string, as a space separated string."""
    folded = rf"strip_accents(regexp_replace(lower(coalesce({c}, '')), '\p{{Mn}}+', '', 'g'))"
    return rf"trim(regexp_replace({folded}, '[^\p{{L}}\p{{N}}\p{{Co}}]+', ' ', 'g'))"


def sql_token_list(c: str) -> str:
    return f"list_filter(string_split({sql_tokens(c)}, ' '), lambda t: t <> '')"
